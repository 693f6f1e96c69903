"""Ratings that carry on from match to match, and strengths that depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

c = F.col
START = 1500.0
RATINGS = "map<int,double>"


def expected_score(home: Column, away: Column, advantage: float) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home + advantage - away) / 400))


def season_elo(days: Column, ratings: Column, k: float, advantage: float) -> Column:
    """A season's days (each with its matches) folded into what each match saw, and the ratings at the end.

    Matches of one day see the ratings of the days before. A day is one element of the result, so
    the fold takes time in proportion to the matches.
    """
    seen = "array<array<struct<match_id:bigint,home_elo:double,away_elo:double,expected:double>>>"
    start = F.struct(ratings.alias("ratings"), F.array().cast(seen).alias("seen"))

    def step(state: Column, day: Column) -> Column:
        of = lambda team: F.try_element_at(state["ratings"], team)
        now = F.transform(day["matches"], lambda m: F.struct(m["match_id"].alias("match_id"), of(m["home"]).alias("home_elo"), of(m["away"]).alias("away_elo"), expected_score(of(m["home"]), of(m["away"]), advantage).alias("expected")))
        move = lambda m: k * (m["scored"] - expected_score(of(m["home"]), of(m["away"]), advantage))
        moves = lambda team: F.aggregate(day["matches"], F.lit(0.0), lambda t, m: t + F.when(m["home"] == team, move(m)).when(m["away"] == team, -move(m)).otherwise(0.0))
        return F.struct(F.transform_values(state["ratings"], lambda team, v: v + moves(team)).alias("ratings"), F.concat(state["seen"], F.array(now)).cast(seen).alias("seen"))

    return F.aggregate(days, start, step)


def elo(matches: DataFrame, k: float = 20.0, home: float = 60.0, carry: float = 0.75) -> DataFrame:
    """Ratings of both sides before each finished match; a new season pulls them towards the start.

    Seasons are steps: each reads the ratings that the one before has written, for all competitions
    at once, and folds its days over them. A task holds one season of one competition.
    """
    scored = F.when(c("home_score") > c("away_score"), 1.0).when(c("home_score") == c("away_score"), 0.5).otherwise(0.0)
    done = matches.where("status = 'finished'").select("competition_id", "season", "day", F.struct("match_id", c("home_team_id").cast("int").alias("home"), c("away_team_id").cast("int").alias("away"), scored.alias("scored")).alias("m"))
    by_day = done.groupBy("competition_id", "season", "day").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    teams = F.array_distinct(F.flatten(F.transform("days", lambda d: F.flatten(F.transform(d["matches"], lambda m: F.array(m["home"], m["away"]))))))
    whole = written(by_day.groupBy("competition_id", "season").agg(F.array_sort(F.collect_list(F.struct("day", "matches"))).alias("days")).withColumn("teams", teams), "elo-seasons")
    order = Window.partitionBy("competition_id").orderBy("season")
    whole = whole.withColumn("step", F.row_number().over(order))  # a competition's seasons, however they are spaced
    steps = whole.agg(F.max("step")).first()[0] or 0
    ratings = done.select("competition_id").distinct().withColumn("ratings", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))
    out: DataFrame | None = None
    for n in range(1, steps + 1):
        pulled = F.transform_values(c("ratings"), lambda _, v: START + carry * (v - START))
        fresh = F.array_except("teams", F.map_keys("ratings"))
        opening = F.map_concat(pulled, F.map_from_arrays(fresh, F.transform(fresh, lambda _: F.lit(START))))
        played = whole.where(c("step") == n).join(ratings, "competition_id").withColumn("opening", opening.cast(RATINGS))
        table = written(played.select("competition_id", season_elo(c("days"), c("opening"), k, home).alias("r")), "elo-ratings")
        ratings = table.select("competition_id", c("r.ratings").alias("ratings"))
        rows = table.select("competition_id", F.explode(F.flatten("r.seen")).alias("x")).select("x.match_id", "competition_id", "x.home_elo", "x.away_elo", "x.expected")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else matches.sparkSession.createDataFrame([], "match_id long, competition_id int, home_elo double, away_elo double, expected double")


def national_strengths(matches: DataFrame, rounds: int = 30, shrink: float = 3.0, still: float = 1e-12, each: int = 3) -> DataFrame:
    """Attack and defence of each team and season, adjusted for its opponents: (goals + shrink) / (due + shrink), by rounds.

    Fixtures are counted by pair, so a half-round is one join of pairs with their opponents' strengths and
    a sum for each team: any competition is spread over tasks by its teams. A half-round needs only
    the one before, so plans grow in proportion to the rounds; every ``each`` rounds the strengths
    are written, which ends their lineage, and compared with those written before: the rounds end
    early when nothing moves by more than ``still``.
    """
    key = ["competition_id", "season"]
    done = matches.where("status = 'finished'")
    side = lambda team, other, gf, ga: F.struct(c(team).alias("team_id"), c(other).alias("opponent_id"), c(gf).alias("gf"), c(ga).alias("ga"))
    sides = done.select(*key, F.explode(F.array(side("home_team_id", "away_team_id", "home_score", "away_score"), side("away_team_id", "home_team_id", "away_score", "home_score"))).alias("s")).select(*key, "s.*")
    pairs = written(sides.groupBy(*key, "team_id", "opponent_id").agg(F.count("*").alias("n"), F.sum("gf").cast("double").alias("gf"), F.sum("ga").cast("double").alias("ga")), "fixtures")
    means = pairs.groupBy(*key).agg(F.greatest(F.sum("gf") / F.sum("n"), F.lit(1e-9)).alias("mean"))
    teams = written(pairs.groupBy(*key, "team_id").agg(F.sum("gf").alias("goals"), F.sum("ga").alias("lost")).join(means, key), "teams")
    def half(of: DataFrame, goals: str) -> DataFrame:
        """Teams' strengths from their goals and their opponents' strengths of the other kind, ``v``."""
        other = of.select(*key, c("team_id").alias("opponent_id"), "v")
        due = pairs.select(*key, "team_id", "opponent_id", "n").join(other, [*key, "opponent_id"]).groupBy(*key, "team_id").agg(F.sum(c("n") * c("v")).alias("due"))
        return teams.join(due, [*key, "team_id"]).select(*key, "team_id", ((c(goals) + shrink) / (c("mean") * c("due") + shrink)).alias("v"))

    defence = teams.select(*key, "team_id", F.lit(1.0).alias("v"))
    before: DataFrame | None = None
    for n in range(1, rounds + 1):
        attack = half(defence, "goals")
        if n % each and n < rounds:
            defence = half(attack, "lost")
            continue
        attack = written(attack, "attack")
        defence = written(half(attack, "lost"), "defence")
        both = attack.withColumnRenamed("v", "attack").join(defence.withColumnRenamed("v", "defence"), [*key, "team_id"])
        if before is not None:
            moved = F.greatest(F.abs(c("a.attack") - c("b.attack")), F.abs(c("a.defence") - c("b.defence")))
            most = both.alias("a").join(before.alias("b"), [c(f"a.{k}") == c(f"b.{k}") for k in (*key, "team_id")]).agg(F.max(moved)).first()[0]
            if most is None or most <= still:
                break
        before = both
    return both

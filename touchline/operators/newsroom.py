"""Stories found in results, what a competition's profile makes of them, and the evidence of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, iso_week
from .text import PUBLISH

c = F.col
#: Runs that make a story of a team, by the points of a match that keep them going, and their least length.
TRENDS = {"winning_run": ((3,), 4), "unbeaten_run": ((3, 1), 7), "losing_run": ((0,), 4), "winless_run": ((1, 0), 7)}
#: A run of the looser kind is no story where all of it is the stricter kind.
STRICTER = {"unbeaten_run": "winning_run", "winless_run": "losing_run"}


def profiled(angles: DataFrame, allowed: DataFrame) -> DataFrame:
    """Scores of matches by the angles that their competition's profile allows.

    angles: (match_id, competition_id, angles: array of angle and weight); allowed: (competition_id, angle),
    a bounded table of settings. A match without an allowed angle scores 0.
    """
    each = angles.select("match_id", "competition_id", F.posexplode_outer("angles").alias("place", "a")).select("match_id", "competition_id", "place", "a.angle", "a.weight")
    kept = each.join(allowed.withColumn("ok", F.lit(True)), ["competition_id", "angle"], "left")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("ok"), F.struct("place", "angle")))), lambda x: x["angle"]), ",")
    score = half_up(F.coalesce(F.sum(F.when(c("ok"), c("weight"))), F.lit(0.0)), 2)
    return kept.groupBy("match_id", "competition_id").agg(named.alias("angles"), score.alias("score")).withColumn("material", c("score") >= PUBLISH)


def team_trends(rows: DataFrame, now: int, window: int) -> DataFrame:
    """Runs up to a team's last match of a season, where that match lies in the window and the run is long enough."""
    key = ["competition_id", "season", "team_id"]
    back = Window.partitionBy(*key).orderBy(F.desc("day"), F.desc("match_id"))
    numbered = rows.where(c("day") <= now).withColumn("k", F.row_number().over(back))
    runs = numbered.groupBy(*key).agg(F.max("day").alias("last"), *[(F.coalesce(F.min(F.when(~c("points").isin(*of), c("k"))), F.count("*") + 1) - 1).cast("long").alias(name) for name, (of, _) in TRENDS.items()])
    found = []
    for name, (_, least) in TRENDS.items():
        told = c(name) >= least
        if name in STRICTER:
            told = told & (c(name) > c(STRICTER[name]))
        found.append(F.when(told, F.struct(F.lit(name).alias("kind"), c(name).alias("run"), F.when(c(name) >= least + 2, 1.4).otherwise(1.0).alias("score"))))
    told = runs.where(c("last") >= now - window).select(*key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("s"))
    return told.select(F.lit("team_trend").alias("story"), "competition_id", "season", c("team_id").cast("long").alias("subject"), "s.kind", "s.run", "s.score")


def player_form(appearances: DataFrame, now: int, window: int, least: int = 3) -> DataFrame:
    """Players who scored in each of their last appearances, the newest in the window; (competition_id, season, player_id, match_id, day, goals)."""
    key = ["competition_id", "season", "player_id"]
    back = Window.partitionBy(*key).orderBy(F.desc("day"), F.desc("match_id"))
    streak = F.coalesce(F.min(F.when(c("goals") == 0, c("k"))), F.count("*") + 1) - 1
    runs = appearances.where(c("day") <= now).withColumn("k", F.row_number().over(back)).groupBy(*key).agg(F.max("day").alias("last"), streak.cast("long").alias("run"))
    told = runs.where((c("last") >= now - window) & (c("run") >= least))
    return told.select(F.lit("player_form").alias("story"), "competition_id", "season", c("player_id").cast("long").alias("subject"), F.lit("scoring_run").alias("kind"), "run", half_up(1.0 + (c("run") - least) * 0.2, 2).alias("score"))


def table_watch(matches: DataFrame, now: int, window: int, least: int = 6) -> DataFrame:
    """Seasons with enough results in the window and no unfinished match on the day."""
    played = (c("status") == "finished") & c("day").between(now - window, now)
    n = matches.where(c("day").between(now - window, now)).groupBy("competition_id", "season").agg(F.count_if(played).alias("run"), F.max(F.when(played, c("day"))).alias("last"), F.count_if((c("status") != "finished") & (c("day") == now)).alias("open"))
    week = iso_week(F.date_add(F.lit("1970-01-01").cast("date"), c("last").cast("int")))
    return n.where((c("run") >= least) & (c("open") == 0)).select(F.lit("table_watch").alias("story"), "competition_id", "season", c("competition_id").cast("long").alias("subject"), week.cast("string").alias("kind"), "run", F.lit(1.0).alias("score"))


def stories_of(matches: DataFrame, rows: DataFrame, appearances: DataFrame, now: int, window: int = 4) -> DataFrame:
    """All stories of the days before now."""
    return reduce(DataFrame.unionByName, [team_trends(rows, now, window), player_form(appearances, now, window), table_watch(matches, now, window)])


def evidence(assembled: DataFrame, loads: DataFrame, angles: DataFrame) -> DataFrame:
    """What may be said of each finished match: one line per known fact in a fixed order, what is missing, how deep it goes, and a hash of it all.

    assembled as ``match_assembly``, loads as ``team_load``, angles as ``materiality``.
    """
    side = lambda team, tag: loads.select("match_id", c("team_id").alias(team), F.floor(c("load") * 100 + 0.5).cast("long").alias(f"{tag}_load"))
    m = assembled.where("status = 'finished'").join(side("home_team_id", "home"), ["match_id", "home_team_id"], "left").join(side("away_team_id", "away"), ["match_id", "away_team_id"], "left").join(angles.select("match_id", "angles"), "match_id", "left")
    pair = lambda x: F.when(c("n_events") > 0, F.concat_ws("-", *[c(f"{t}_{x}").cast("string") for t in ("home", "away")]))
    given = lambda x: F.when(c(x) != "", c(x))
    facts = {
        "result": F.concat_ws("-", c("home_score").cast("string"), c("away_score").cast("string")),
        "goals": given("timeline"),
        "shots": pair("shots"),
        "on_target": pair("on_target"),
        "lineup": given("lineup"),
        "busiest": c("busiest").cast("string"),
        "loads": F.when(c("home_load").isNotNull() & c("away_load").isNotNull(), F.concat_ws("-", c("home_load").cast("string"), c("away_load").cast("string"))),
        "angles": given("angles"),
    }
    lines = F.filter(F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in facts.items()]), lambda x: x.isNotNull())
    missing = F.filter(F.array(*[F.when(v.isNull(), k) for k, v in facts.items()]), lambda x: x.isNotNull())
    out = m.select("match_id", F.size(lines).alias("n_facts"), F.array_join(lines, "\n").alias("facts"), F.array_join(missing, ",").alias("missing"))
    depth = F.when(c("n_facts") == len(facts), "full").when(c("missing").contains("shots"), "result").otherwise("events")
    return out.select("match_id", "n_facts", "missing", depth.alias("depth"), F.sha2(F.concat_ws("\n", c("match_id").cast("string"), "facts"), 256).alias("packet_hash"))


def record_windows(grades: DataFrame, sizes: tuple[int, ...] = (30, 60, 100)) -> DataFrame:
    """The record over the last settled picks: only as many as the largest size are ranked. (match_id, day, probability, grade)."""
    newest = grades.where("grade <> 'pending'").orderBy(F.desc("day"), F.desc("match_id")).limit(max(sizes))
    ranked = newest.withColumn("k", F.row_number().over(Window.orderBy(F.desc("day"), F.desc("match_id"))))
    each = ranked.withColumn("last", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(c("k") <= c("last"))
    won, lost = F.count_if(c("grade") == "won"), F.count_if(c("grade") == "lost")
    return each.groupBy("last").agg(F.count("*").alias("picks"), won.alias("won"), lost.alias("lost"), F.count_if(c("grade") == "void").alias("void"), half_up(F.try_divide(won.cast("double"), (won + lost).cast("double")), 4).alias("hit_rate"), half_up(F.sum(F.when(c("grade").isin("won", "lost"), c("probability"))), 4).alias("expected"))

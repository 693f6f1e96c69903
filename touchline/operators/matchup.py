"""Inputs, profiles and comparisons of two sides before a match, as of a day: nothing of that day or later counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, half_up
from .profiles import weighted

c = F.col
#: Families of event data, the richest first; a match is read from one of them, so nothing counts twice.
FAMILIES = ["wyscout_figshare", "espn", "openligadb"]
_LOCATED = "event_type = 'shot' and x_m is not null and y_m is not null"
#: What is counted of a side's events in a match.
COUNTERS = {
    "shots": "event_type = 'shot'",
    "on_target": "event_type = 'shot' and outcome = 'success'",
    "located": _LOCATED,
    "inside": f"{_LOCATED} and x_m >= 88.5D and abs(y_m - 34.0D) <= 20.16D",
    "left": f"{_LOCATED} and y_m > 2 * 68 / 3",
    "right": f"{_LOCATED} and y_m < 68 / 3",
    "set_pieces": f"{_LOCATED} and set_piece",
}
#: The seven components of the matchup rating, what they weigh, and the difference that is a full edge.
MATCHUP = {"attack": (0.2, 6.0), "defence": (0.2, 1.2), "shot_profile": (0.15, 0.25), "set_piece": (0.05, 3.0), "form": (0.15, 1.5), "rest": (0.15, 40.0), "eleven": (0.1, 0.3)}
#: The groups of the analyzer's components and what they weigh.
GROUPS = {"results": 0.5, "style": 0.3, "schedule": 0.2}


def games(rows: DataFrame, events: DataFrame) -> DataFrame:
    """A team's matches with its own counters and its opponent's (``o_``), from the richest family of each match.

    events has a boolean set_piece. A match without events has null counters. Goals are split by half
    (``first``, ``second``); an own goal is the other side's.
    """
    own = {side: c("team_id") == c(f"{side}_team_id") for side in ("home", "away")}
    scored = {side: (c("is_goal") & own[side]) | (c("is_own_goal") & ~own[side]) for side in own}
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), c("source_family")), F.lit(0))
    counts = [F.count_if(F.expr(p) & own[side]).alias(f"{side}_{k}") for side in own for k, p in COUNTERS.items()]
    halves = [F.count_if(scored[side] & (half == (c("minute") <= 45))).alias(f"{side}_{k}") for side in own for k, half in (("first", F.lit(True)), ("second", F.lit(False)))]
    by_family = events.groupBy("match_id", "source_family").agg(*counts, *halves).withColumn("rank", F.when(rank > 0, rank).otherwise(len(FAMILIES) + 1))
    facts = by_family.groupBy("match_id").agg(F.min_by(F.struct(*[x for x in by_family.columns if x not in ("match_id", "rank")]), F.struct("rank", "source_family")).alias("f")).select("match_id", "f.*")
    names = [*COUNTERS, "first", "second"]
    mine = [F.when(c("is_home"), c(f"home_{k}")).otherwise(c(f"away_{k}")).alias(k) for k in names]
    theirs = [F.when(c("is_home"), c(f"away_{k}")).otherwise(c(f"home_{k}")).alias(f"o_{k}") for k in names]
    return rows.join(facts, "match_id", "left").select("match_id", "competition_id", "season", "day", "team_id", "is_home", "gf", "ga", "points", c("source_family").alias("family"), *mine, *theirs)


def latest(played: DataFrame, as_of: int, last: int, *keys: str) -> DataFrame:
    """The last matches before a day by keys; k counts back from the newest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("day"), F.desc("match_id"))
    return played.where(c("day") < as_of).withColumn("k", F.row_number().over(order)).where(c("k") <= last)


def _per(total: str, by: Column) -> Column:
    return half_up(F.try_divide(F.sum(total).cast("double"), by.cast("double")), 2)


def team_profile(played: DataFrame, as_of: int, last: int = 8) -> DataFrame:
    """Each team's last matches in any competition: a match's goals and shots either way, where its shots come from, goals by half, form and the split by venue."""
    n = F.count("*")
    mean = lambda x, when=None: half_up(F.avg(x if when is None else F.when(when, c(x))), 2)
    letter = F.when(c("points") == 3, "W").when(c("points") == 1, "D").otherwise("L")
    form = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("k", letter.alias("l")))), 1, 5), lambda x: x["l"]), "")
    return latest(played, as_of, last, "team_id").groupBy("team_id").agg(
        n.alias("matches"), F.count("shots").alias("with_stats"), F.count_if(c("located") > 0).alias("with_located"),
        mean("gf").alias("goals_for"), mean("ga").alias("goals_against"), mean("shots").alias("shots_for"), mean("o_shots").alias("shots_against"),
        mean("on_target").alias("on_target_for"), mean("o_on_target").alias("on_target_against"),
        *[_per(x, F.sum("located")).alias(f"{x}_share") for x in ("inside", "left", "right")],
        half_up(F.try_divide((F.sum("located") - F.sum("left") - F.sum("right")).cast("double"), F.sum("located").cast("double")), 2).alias("centre_share"),
        _per("set_pieces", F.count_if(c("located") > 0)).alias("set_pieces_for"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(f"goals_{x}") for x in ("first", "second")], *[F.coalesce(F.sum(f"o_{x}"), F.lit(0)).alias(f"conceded_{x}") for x in ("first", "second")],
        form.alias("form"), mean("points", c("k") <= 5).alias("points_last_five"), mean("points", c("is_home")).alias("points_home"), mean("points", ~c("is_home")).alias("points_away"),
    )


def schedule(played: DataFrame, as_of: int) -> DataFrame:
    """Days since each team's last match, matches in the last 7 and 14 days, and the load of them from 0 to 100, in all competitions."""
    days = played.where(c("day") < as_of).groupBy("team_id").agg((as_of - F.max("day")).alias("rest"), *[F.count_if(c("day") >= as_of - k).alias(f"last_{k}") for k in (7, 14)])
    load = weighted({"congestion": (F.least(c("last_14") / 5.0, F.lit(1.0)), 0.5), "rest": (F.greatest(F.lit(0.0), 1 - c("rest") / 7.0), 0.3)})
    return days.withColumn("load", half_up(load * 100, 2))


def continuity(played: DataFrame, starters: DataFrame, as_of: int, last: int = 8) -> DataFrame:
    """Share of the starters kept from one known eleven to the next, over each team's last matches; starters: (match_id, team_id, player_id)."""
    elevens = starters.groupBy("match_id", "team_id").agg(F.collect_set("player_id").alias("eleven"))
    known = latest(played, as_of, last, "team_id").select("match_id", "team_id", "k").join(elevens, ["match_id", "team_id"])
    before = F.lag("eleven").over(Window.partitionBy("team_id").orderBy(F.desc("k")))
    kept = known.withColumn("before", before).withColumn("kept", F.size(F.array_intersect("eleven", "before")) / F.size("before").cast("double"))
    return kept.groupBy("team_id").agg(F.count("*").alias("elevens"), half_up(F.avg(F.when(c("before").isNotNull(), c("kept"))), 2).alias("kept"))


def _both(fixtures: DataFrame, teams: DataFrame, *also: str) -> DataFrame:
    """The fixtures with both sides' rows as h_ and a_; missing sides are null."""
    out = fixtures
    for tag, side in (("h", "home_team_id"), ("a", "away_team_id")):
        mine = teams.select(*[c(x).alias(f"{tag}_{x}") for x in teams.columns])
        same = c(side) == c(f"{tag}_team_id")
        for x in also:
            same = same & (c(x) == c(f"{tag}_{x}"))
        out = out.join(mine, same, "left").drop(*[f"{tag}_{x}" for x in ("team_id", *also)])
    return out


def board(fixtures: DataFrame, profiles: DataFrame, loads: DataFrame, elevens: DataFrame) -> DataFrame:
    """Fixtures with both sides' loads and a rating of seven components; a component that a side lacks is left out and the weights made up for."""
    teams = profiles.join(loads, "team_id", "left").join(elevens, "team_id", "left")
    b = _both(fixtures, teams)
    pair = lambda x: (c(f"h_{x}"), c(f"a_{x}"))
    minus = lambda x: (-c(f"h_{x}"), -c(f"a_{x}"))
    expected = ((c("h_shots_for") + c("a_shots_against")) / 2, (c("a_shots_for") + c("h_shots_against")) / 2)
    sides = {"attack": expected, "defence": minus("goals_against"), "shot_profile": pair("inside_share"), "set_piece": pair("set_pieces_for"), "form": pair("points_last_five"), "rest": minus("load"), "eleven": pair("kept")}
    edge = {k: half_up(F.when(h.isNotNull() & a.isNotNull(), clamp((half_up(h, 2) - half_up(a, 2)) / MATCHUP[k][1], -1.0, 1.0)), 2) for k, (h, a) in sides.items()}
    b = b.select("match_id", "day", "home_team_id", "away_team_id", c("h_load").alias("home_load"), c("a_load").alias("away_load"), *[e.alias(k) for k, e in edge.items()])
    lean = weighted({k: (c(k), w) for k, (w, _) in MATCHUP.items()})
    used = sum((c(k).isNotNull().cast("int") for k in MATCHUP), F.lit(0))
    return b.select("*", half_up(50 + 50 * lean, 0).cast("long").alias("home_rating"), half_up(50 - 50 * lean, 0).cast("long").alias("away_rating"), used.alias("components_used"))


def _season_sides(played: DataFrame, as_of: int) -> DataFrame:
    """A team's last ten matches of a competition's season, and the whole of it."""
    key = ("competition_id", "season", "team_id")
    return latest(played, as_of, 1 << 30, *key).groupBy(*key).agg(
        *[F.avg(F.when(c("k") <= n, c("points"))).alias(f"form{n}") for n in (5, 10)], *[F.count_if(c("k") <= n).alias(f"n{n}") for n in (5, 10)],
        F.avg(F.when(c("k") <= 10, c("gf"))).alias("scoring"), F.avg(F.when(c("k") <= 10, c("ga"))).alias("conceding"), F.avg(F.when(c("k") <= 10, c("gf") - c("ga"))).alias("gd"),
        F.count("*").alias("played"), F.avg("gf").alias("season_scoring"), F.avg("ga").alias("season_conceding"),
        F.avg(F.when(c("is_home"), c("points"))).alias("at_home"), F.count_if("is_home").alias("n_home"), F.avg(F.when(~c("is_home"), c("points"))).alias("away"), F.count_if(~c("is_home")).alias("n_away"),
    )


def _styles(fixtures: DataFrame, played: DataFrame, as_of: int) -> DataFrame:
    """Shots of both sides' last ten matches by the family that counted them; of the families both have, the one with most matches on the thinner side."""
    key = ("competition_id", "season", "team_id")
    by = latest(played, as_of, 10, *key).where("shots is not null and o_shots is not null").groupBy(*key, "family").agg(
        F.count("*").alias("n"), F.avg("shots").alias("shots"), F.avg("o_shots").alias("against"), F.avg(c("shots") - c("o_shots")).alias("diff"), F.avg(c("on_target") - c("o_on_target")).alias("target_diff")
    )
    b = _both(fixtures, by, "competition_id", "season").where("h_family = a_family")
    pick = F.struct(-F.least("h_n", "a_n"), c("h_family"))
    return b.groupBy("match_id").agg(F.min_by(F.struct(*[f"{t}_{x}" for t in "ha" for x in ("n", "shots", "against", "diff", "target_diff")]), pick).alias("style"))


def analyzer(fixtures: DataFrame, played: DataFrame, starters: DataFrame, as_of: int) -> DataFrame:
    """Comparison of two sides by fifteen components in three groups.

    A component counts where both sides have a value and its least sample; a group's components weigh
    alike, and the groups' weights are made up for where one is empty. The rating is withheld (null)
    with under three results a side or three components. Shots are compared only within one family.
    """
    b = _both(fixtures, _season_sides(played, as_of), "competition_id", "season").join(_styles(fixtures, played, as_of), "match_id", "left")
    b = _both(b, schedule(played, as_of).select("team_id", "rest", "last_7").join(continuity(played, starters, as_of, 10), "team_id", "left"))

    def component(key, group, home, away, n_home, n_away, scale, lower=False, least=3):
        home, away = (c(x).cast("double") for x in (home, away))
        edge = half_up(clamp((home - away) / scale, -1.0, 1.0) * (-1.0 if lower else 1.0), 2)
        enough = (F.coalesce(n_home, F.lit(0)) >= least) & (F.coalesce(n_away, F.lit(0)) >= least)
        return F.struct(F.lit(key).alias("key"), F.lit(group).alias("group"), F.when(enough, edge).alias("edge"))

    def both(key, group, x, n, scale, lower=False, least=3):
        return component(key, group, f"h_{x}", f"a_{x}", c(f"h_{n}"), c(f"a_{n}"), scale, lower, least)

    def style(key, x, scale, lower=False):
        return component(key, "style", f"style.h_{x}", f"style.a_{x}", c("style.h_n"), c("style.a_n"), scale, lower)

    seen = lambda t: F.when(c(f"{t}_rest").isNotNull(), 1)
    parts = F.array(
        both("form5", "results", "form5", "n5", 1.5), both("form10", "results", "form10", "n10", 1.5),
        both("scoring", "results", "scoring", "n10", 1.5), both("conceding", "results", "conceding", "n10", 1.5, True), both("gd", "results", "gd", "n10", 2.0),
        both("season_scoring", "results", "season_scoring", "played", 1.5), both("season_conceding", "results", "season_conceding", "played", 1.5, True),
        component("venue", "results", "h_at_home", "a_away", c("h_n_home"), c("a_n_away"), 1.5),
        style("shots", "shots", 6.0), style("suppression", "against", 6.0, True), style("shot_diff", "diff", 6.0), style("target_diff", "target_diff", 3.0),
        component("rest", "schedule", "h_rest", "a_rest", seen("h"), seen("a"), 7.0, least=1), component("load7", "schedule", "h_last_7", "a_last_7", seen("h"), seen("a"), 3.0, True, 1),
        both("eleven", "schedule", "kept", "elevens", 0.3, least=2),
    )
    out = b.select("match_id", "h_n10", "a_n10", F.filter(parts, lambda p: p["edge"].isNotNull()).alias("used"), F.filter(parts, lambda p: p["edge"].isNull()).alias("omitted"))

    def mean_edge(group):
        of = F.filter("used", lambda p: p["group"] == group)
        return F.when(F.size(of) > 0, F.aggregate(of, F.lit(0.0), lambda a, p: a + p["edge"]) / F.size(of))

    enough = (F.coalesce("h_n10", F.lit(0)) >= 3) & (F.coalesce("a_n10", F.lit(0)) >= 3) & (F.size("used") >= 3)
    out = out.withColumn("lean", F.when(enough, weighted({g: (mean_edge(g), w) for g, w in GROUPS.items()})))
    label = F.when(c("lean").isNull(), "withheld").when(F.exists("used", lambda p: p["group"] == "style"), "results and shots").otherwise("results and schedule")
    return out.select("match_id", half_up(50 + 50 * c("lean"), 0).cast("long").alias("home_rating"), half_up(50 - 50 * c("lean"), 0).cast("long").alias("away_rating"), F.size("used").alias("components_used"), F.array_join(F.transform("omitted", lambda p: p["key"]), ",").alias("omitted"), label.alias("label"))


def season_context(rows: DataFrame, windows: tuple[int, ...] = (3, 5)) -> DataFrame:
    """A team's season beside its last earlier ones in the same competition, one row for each window of seasons.

    Baselines weigh seasons by their matches; a window with fewer earlier seasons takes what there are,
    and without any there is no row. Changes are the season's goals a match less the baseline's.
    """
    key = ["competition_id", "team_id"]
    seasons = rows.groupBy(*key, "season").agg(F.count("*").alias("played"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    order = Window.partitionBy(*key).orderBy("season")
    before = lambda x, n: F.sum(x).over(order.rowsBetween(-n, -1))
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.count("*").over(order.rowsBetween(-n, -1)).alias("seasons"), *[before(x, n).alias(f"{x}_before") for x in ("played", "gf", "ga")]) for n in windows])
    known = seasons.select("*", each.alias("ws")).select(*key, "season", "played", "gf", "ga", F.explode("ws").alias("w")).select(*key, "season", "played", "gf", "ga", "w.*").where("seasons > 0")
    rate = lambda x, n: half_up(c(x) / c(n), 2)
    out = known.select(*key, "season", "window", "seasons", c("played_before").alias("matches"), "played", *[rate(f"{x}_before", "played_before").alias(f"{name}_before") for x, name in (("gf", "scored"), ("ga", "conceded"))], rate("gf", "played").alias("scored"), rate("ga", "played").alias("conceded"))
    return out.select("*", half_up(c("scored") - c("scored_before"), 2).alias("scored_change"), half_up(c("conceded") - c("conceded_before"), 2).alias("conceded_change"))


def meetings_before(fixtures: DataFrame, matches: DataFrame, as_of: int) -> DataFrame:
    """Earlier meetings of each fixture's teams, either way round, from the home side's view: (match_id, home_team_id, away_team_id).

    Meetings are summed by pair and orientation first, so a fixture meets two rows at most.
    """
    done = matches.where((c("status") == "finished") & (c("day") < as_of))
    sums = done.groupBy(c("home_team_id").alias("h"), c("away_team_id").alias("a")).agg(
        F.count("*").alias("n"), F.count_if(c("home_score") > c("away_score")).alias("h_won"), F.count_if(c("home_score") == c("away_score")).alias("drawn"), F.sum("home_score").alias("h_goals"), F.sum("away_score").alias("a_goals"), F.max("day").alias("last")
    )
    lost = c("n") - c("h_won") - c("drawn")
    either = sums.select(c("h").alias("home_team_id"), c("a").alias("away_team_id"), "n", c("h_won").alias("won"), "drawn", c("h_goals").alias("gf"), c("a_goals").alias("ga"), "last")
    either = either.unionByName(sums.select(c("a").alias("home_team_id"), c("h").alias("away_team_id"), "n", lost.alias("won"), "drawn", c("a_goals").alias("gf"), c("h_goals").alias("ga"), "last"))
    whole = either.groupBy("home_team_id", "away_team_id").agg(F.max("last").alias("last_day"), *[F.sum(x).cast("long").alias(x) for x in ("n", "won", "drawn", "gf", "ga")])
    met = fixtures.select("match_id", "home_team_id", "away_team_id").join(whole, ["home_team_id", "away_team_id"], "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0).cast("long"))
    return met.select("match_id", zero("n").alias("meetings"), zero("won").alias("home_won"), zero("drawn").alias("drawn"), (zero("n") - zero("won") - zero("drawn")).alias("away_won"), zero("gf").alias("home_goals"), zero("ga").alias("away_goals"), "last_day")

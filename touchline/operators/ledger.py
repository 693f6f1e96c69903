"""The event ledger: counts, minutes, phases, shots, running scores, nearest events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, in_area, phase, ratio, third
from .ordered import before

c = F.col

#: Counts by name; a further count is a further predicate. Both sides use the same names.
TEAM_STATS: dict[str, str] = {
    "passes": "event_type = 'pass'",
    "passes_completed": "event_type = 'pass' and outcome = 'success'",
    "shots": "event_type = 'shot'",
    "shots_on_target": "event_type = 'shot' and outcome = 'success'",
    "shots_off_target": "event_type = 'shot' and outcome = 'fail'",
    "goals": "is_goal",
    "own_goals": "is_own_goal",
    "fouls": "event_type = 'foul'",
    "duels": "event_type = 'duel'",
    "duels_won": "event_type = 'duel' and outcome = 'success'",
    "first_half": "minute <= 45",
    "second_half": "minute > 45",
    "located": "x_m is not null",
    "final_third": "x_m >= 70",
    "area_events": "x_m >= 88.5 and abs(y_m - 34) <= 20.16",
    "area_shots": "event_type = 'shot' and x_m >= 88.5 and abs(y_m - 34) <= 20.16",
}
PLAYER_STATS: dict[str, str] = {k: v for k, v in TEAM_STATS.items() if k != "located"}


def counts(events: DataFrame, keys: list[str], stats: dict[str, str], zeros: bool) -> DataFrame:
    """stat_key and value by keys: one pass over the ledger, then one row per count."""
    wide = events.groupBy(*keys).agg(*[F.count_if(F.expr(p)).alias(name) for name, p in stats.items()])
    tall = wide.unpivot(keys, list(stats), "stat_key", "value")
    return tall if zeros else tall.where("value > 0")


def for_home() -> Column:
    """Whether a goal counts for the home side; an own goal counts for the other one."""
    by_home = c("team_id") == c("home_team_id")
    return F.when(c("is_own_goal"), ~by_home).otherwise(by_home)


def goals(events: DataFrame) -> DataFrame:
    return events.where("is_goal or is_own_goal").withColumn("home", for_home())


def running_score(events: DataFrame) -> DataFrame:
    """Score after each goal of a match, and before it."""
    order = Window.partitionBy("match_id").orderBy("sequence")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    home, away = F.when(c("home"), 1).otherwise(0), F.when(c("home"), 0).otherwise(1)
    total = lambda x, frame: F.coalesce(F.sum(x).over(frame), F.lit(0)).cast("long")
    return goals(events).select(
        "match_id", "sequence", "minute", "player_id", "is_own_goal",
        total(home, upto).alias("home_score"), total(away, upto).alias("away_score"),
        total(home, before).alias("home_before"), total(away, before).alias("away_before"),
        (c("minute") - F.lag("minute").over(order)).alias("since_goal"),
    )


def score_check(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Goals of the ledger against the recorded score, by match."""
    counted = goals(events).groupBy("match_id").agg(F.count_if(c("home")).alias("home_goals"), F.count_if(~c("home")).alias("away_goals"))
    done = matches.where("status = 'finished'").select("match_id", "home_score", "away_score")
    zero = lambda x: F.coalesce(c(x), F.lit(0)).cast("long").alias(x)
    both = done.join(counted, "match_id", "left").select("match_id", "home_score", "away_score", zero("home_goals"), zero("away_goals"))
    return both.withColumn("agrees", (c("home_score") == c("home_goals")) & (c("away_score") == c("away_goals")))


def _appearance() -> list[Column]:
    """When a player came on and was sent off."""
    return [F.min("sequence").alias("first"), F.min("minute").alias("entered"), F.min(F.when(c("card") == "red", c("minute"))).alias("dismissed")]


def _nominal(full: int) -> list[Column]:
    starter = c("first") <= 3
    since = F.when(starter, 0).otherwise(c("entered"))
    until = F.least(F.lit(full), F.coalesce("dismissed", F.lit(full)))
    return [starter.alias("is_starter"), F.greatest(F.lit(0), until - since).cast("long").alias("minutes")]


def minutes(events: DataFrame, full: int = 90) -> DataFrame:
    """Nominal minutes: starters from 0, others from their first event; until their first red card, or the end."""
    player = events.groupBy("match_id", "team_id", "player_id").agg(*_appearance())
    return player.select("match_id", "team_id", "player_id", *_nominal(full))


#: A player's counters in a match, besides the minutes.
IMPACT = {
    "goals": "is_goal", "own_goals": "is_own_goal", "assists": "subtype = 'assist'", "key_passes": "subtype = 'key_pass'", "shots": "event_type = 'shot'", "shots_on_target": "event_type = 'shot' and outcome = 'success'",
    "passes": "event_type = 'pass'", "completed": "event_type = 'pass' and outcome = 'success'", "tackles": "subtype = 'tackle'", "interceptions": "subtype = 'interception'", "clearances": "subtype = 'clearance'", "saves": "subtype = 'save'",
    "fouls": "event_type = 'foul'", "duels": "event_type = 'duel'", "yellow_cards": "card = 'yellow'", "red_cards": "card = 'red'",
}


def impact(events: DataFrame) -> DataFrame:
    """A player's counters in a match, with nominal minutes."""
    names = [*[f"n_{k}" for k in IMPACT], "n_events"]
    counted = [*[F.count_if(F.expr(p)).alias(f"n_{k}") for k, p in IMPACT.items()], F.count("*").alias("n_events")]
    player = events.groupBy("match_id", "team_id", "player_id").agg(*_appearance(), *counted).where("match_id is not null and player_id is not null")
    # A player of both teams has a row for each, with the counters of both.
    both = Window.partitionBy("match_id", "player_id")
    return player.select("match_id", "player_id", *[F.sum(n).over(both).alias(n) for n in names], *_nominal(90))


def phases(events: DataFrame) -> DataFrame:
    """Shots, shots on target and goals by fifteen-minute phase and side; empty phases are left out."""
    side = F.when(c("team_id") == c("home_team_id"), "home").otherwise("away")
    out = events.withColumn("phase", phase(c("minute"))).groupBy("match_id", "phase", side.alias("side")).agg(
        F.count_if(F.expr("event_type = 'shot'")).alias("shots"), F.count_if(F.expr("event_type = 'shot' and outcome = 'success'")).alias("on_target"), F.count_if(c("is_goal")).alias("goals")
    )
    return out.where("shots > 0 or goals > 0")


def shot_profile(events: DataFrame) -> DataFrame:
    """A team's shots: conversion, share inside the area, mean distance of located ones."""
    shots = events.where("event_type = 'shot'")
    located = c("x_m").isNotNull()
    inside = F.count_if(in_area(c("x_m"), c("y_m")))
    return shots.groupBy("team_id").agg(
        F.count("*").alias("shots"), F.count_if(c("is_goal")).alias("goals"), F.count_if(located).alias("located"), inside.alias("inside"),
        ratio(F.count_if(c("is_goal")), F.count("*")).alias("conversion"),
        ratio(inside, F.count_if(located)).alias("inside_share"),
        half_up(F.avg(F.when(located, F.hypot(105.0 - c("x_m"), 34.0 - c("y_m")))), 2).alias("mean_distance"),
    )


def missing_fields(events: DataFrame) -> DataFrame:
    """How many shots carry each field, by source family."""
    return events.where("event_type = 'shot'").groupBy("source_family").agg(
        F.count("*").alias("shots"), F.count("x_m").alias("with_place"), F.count("player_id").alias("with_player"), F.count("minute").alias("with_minute"), F.count_if(c("x_m").isNull()).alias("without_place")
    )


def first_scorer(events: DataFrame) -> DataFrame:
    g = goals(events)
    first = lambda x: F.min_by(x, "sequence").alias(x)
    return g.groupBy("match_id").agg(first("player_id"), first("minute"), first("is_own_goal"), first("home"))


def assists(events: DataFrame, reach: int = 6) -> DataFrame:
    """For every goal the nearest earlier completed pass of its team within ``reach`` places.

    A ranged join on (match, team) with the places as bound, and the nearest kept by aggregation.
    """
    scored = events.where("is_goal").select("match_id", "team_id", c("sequence").alias("goal_at"), c("player_id").alias("scorer"))
    passed = events.where("event_type = 'pass' and outcome = 'success'").select("match_id", "team_id", c("sequence").alias("pass_at"), c("player_id").alias("passer"))
    near = scored.join(passed, ["match_id", "team_id"]).where((c("pass_at") < c("goal_at")) & (c("pass_at") >= c("goal_at") - reach))
    return near.groupBy("match_id", "goal_at", "scorer").agg(F.max("pass_at").alias("pass_at"), F.max_by("passer", "pass_at").alias("assist"))


def last_pass_before(events: DataFrame) -> DataFrame:
    """The same without a join: the last completed pass of the team before each goal."""
    before = Window.partitionBy("match_id", "team_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    tagged = events.withColumn("passer", F.last(F.when(F.expr("event_type = 'pass' and outcome = 'success'"), c("player_id")), ignorenulls=True).over(before))
    return tagged.where("is_goal").select("match_id", "sequence", "player_id", "passer")


#: Source families from richest to poorest.
FAMILIES = ["wyscout_figshare", "espn", "openligadb"]


def best_family(events: DataFrame) -> DataFrame:
    """Events of the richest family of each match only."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), c("source_family"))
    ranked = events.withColumn("rank", rank)
    return ranked.withColumn("best", F.min("rank").over(Window.partitionBy("match_id"))).where("rank = best").drop("rank", "best")


def pulse(events: DataFrame, back: int = 10) -> DataFrame:
    """Shots of a team so far and in the minutes just before, at each of its shots."""
    shots = events.where("event_type = 'shot'")
    w = Window.partitionBy("match_id", "team_id").orderBy("minute")
    return shots.select("match_id", "team_id", "sequence", "minute", F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.count("*").over(w.rangeBetween(-back, 0)).alias("recent"))


def key_performers(events: DataFrame, k: int = 4) -> DataFrame:
    """The first k players of each team by goals, shots on target, completed passes, duels won, id."""
    sums = events.groupBy("team_id", "player_id").agg(*[F.count_if(F.expr(TEAM_STATS[n])).alias(n) for n in ("goals", "shots_on_target", "passes_completed", "duels_won")])
    order = Window.partitionBy("team_id").orderBy(F.desc("goals"), F.desc("shots_on_target"), F.desc("passes_completed"), F.desc("duels_won"), "player_id")
    return sums.withColumn("place", F.row_number().over(order)).where(c("place") <= k)


def thirds(events: DataFrame) -> DataFrame:
    """Located events of a team by third of the pitch, side by side."""
    located = events.where("x_m is not null").select("team_id", third(c("x_m")).alias("third"))
    return located.groupBy("team_id").pivot("third", ["defensive", "middle", "final"]).count()


#: Rates of a player's profile that get percentiles; of the last one less is better.
PLAYER_METRICS = ["start_rate", "minutes_per_appearance", "goals_per90", "assists_per90", "goal_contributions_per90", "shots_per90", "shots_on_target_rate", "goals_per_shot", "key_passes_per90", "cards_per90"]
LEAST_MINUTES = 450


def player_profile(events: DataFrame, played: DataFrame, last: int = 5) -> DataFrame:
    """A player's counts, rates, home and away split and last appearances. A red card counts as two; rates without minutes, appearances or shots are missing."""
    cards = F.sum(F.when(c("card") == "red", 2).when(c("card") == "yellow", 1).otherwise(0))
    names = ["goals", "assists", "key_passes", "shots", "shots_on_target", "passes", "completed"]
    by_match = events.groupBy("match_id", "player_id").agg(F.max("day").alias("day"), F.max(c("team_id") == c("home_team_id")).alias("home"), cards.cast("long").alias("cards"), *[F.count_if(F.expr(IMPACT[k])).alias(k) for k in names])
    apps = by_match.join(played.select("match_id", "player_id", "is_starter", "minutes"), ["match_id", "player_id"])
    newest = Window.partitionBy("player_id").orderBy(F.desc("day"), F.desc("match_id"))
    total = lambda x, when=None: F.coalesce(F.sum(c(x) if when is None else F.when(when, c(x))), F.lit(0)).cast("long")
    late = c("k") <= last
    sums = apps.withColumn("k", F.row_number().over(newest)).groupBy("player_id").agg(
        F.count("*").alias("appearances"), F.count_if("is_starter").alias("starts"), F.count_if(~c("is_starter")).alias("sub_appearances"), total("minutes").alias("minutes"), *[total(k).alias(k) for k in [*names, "cards"]],
        F.count_if("home").alias("home_appearances"), total("goals", c("home")).alias("home_goals"), F.count_if(~c("home")).alias("away_appearances"), total("goals", ~c("home")).alias("away_goals"),
        F.count_if(late).alias("last_appearances"), total("goals", late).alias("last_goals"), total("shots", late).alias("last_shots"),
    )
    per = lambda a, b: ratio(a, b, 2)
    n90 = c("minutes") / 90
    return sums.select(
        "*", per(c("starts"), c("appearances")).alias("start_rate"), per(c("minutes"), c("appearances")).alias("minutes_per_appearance"), per(c("goals"), n90).alias("goals_per90"), per(c("assists"), n90).alias("assists_per90"),
        per(c("goals") + c("assists"), n90).alias("goal_contributions_per90"), per(c("shots"), n90).alias("shots_per90"), per(c("shots_on_target"), c("shots")).alias("shots_on_target_rate"), per(c("goals"), c("shots")).alias("goals_per_shot"),
        per(c("key_passes"), n90).alias("key_passes_per90"), per(c("cards"), n90).alias("cards_per90"), per(c("completed"), c("passes")).alias("pass_accuracy"),
    )


def with_percentiles(profiles: DataFrame, keys: list[str], metrics: list[str], lower: tuple[str, ...], eligible: Column, pool: tuple[str, ...] = ()) -> DataFrame:
    """Profiles with p_<metric>: the mid-rank percentile of each metric among the eligible profiles of a pool; all metrics in one pass over the values."""
    each = profiles.where(eligible).unpivot(list(dict.fromkeys([*keys, *pool])), metrics, "metric", "value")
    signed = each.withColumn("value", F.when(c("metric").isin(*lower), -c("value")).otherwise(c("value"))) if lower else each
    ranked = mid_rank_percentile(signed, "value", *pool, "metric")
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when(c("metric") == m, c("percentile"))).alias(f"p_{m}") for m in metrics])
    return profiles.join(wide, keys, "left")


def mid_rank_percentile(df: DataFrame, value: str, *pool: str, lower_is_better: bool = False) -> DataFrame:
    """(rank below + half of the equal ones) / (n - 1) in percent, rounded half up; missing values get none."""
    known = df.where(c(value).isNotNull()).withColumn("pct_v", -c(value) if lower_is_better else c(value))
    levels = before(known, "pct_v", {}, pool=tuple(pool))
    sizes = levels.groupBy(*pool).agg(F.sum("n").alias("pct_n"))
    share = c("before_n") + 0.5 * (c("n") - 1)
    places = (levels.join(sizes, list(pool)) if pool else levels.join(F.broadcast(sizes))).select(*pool, "pct_v", F.floor(F.when(c("pct_n") > 1, share / (c("pct_n") - 1) * 100) + 0.5).cast("long").alias("percentile"))
    return known.join(places, [*pool, "pct_v"]).drop("pct_v")


def sequences_agree(goals: DataFrame) -> DataFrame:
    """Whether a match's goals in order add up, one by one, to the totals told with them: running scores with ``told``."""
    step = (c("home_score") - c("home_before") + c("away_score") - c("away_before") == 1) & (c("told") == c("home_score") + c("away_score"))
    return goals.groupBy("match_id").agg(F.count("*").alias("goals"), F.min(step).alias("consistent"))

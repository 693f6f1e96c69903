"""Whole matches, directories, loads and lineups put together from the ledger and the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, ratio
from .ledger import FAMILIES, mid_rank_percentile

c = F.col


def listed(items: Column, order: Column, separator: str = ",") -> Column:
    """A group's items as one text, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), items.alias("i")))), lambda x: x["i"]), separator)


def match_assembly(matches: DataFrame, events: DataFrame, played: DataFrame) -> DataFrame:
    """One row for each match: its goals in order, shots by side, counts, line-ups and busiest player.

    Every part is first one row for each match; a match's events are bounded by the match.
    """
    home = c("team_id") == c("home_team_id")
    side = lambda h: home if h else ~home
    shot = c("event_type") == "shot"
    goal = c("is_goal") | c("is_own_goal")
    ledger = events.groupBy("match_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(shot & side(True)).alias("home_shots"), F.count_if(shot & side(False)).alias("away_shots"),
        F.count_if(shot & (c("outcome") == "success") & side(True)).alias("home_on_target"), F.count_if(shot & (c("outcome") == "success") & side(False)).alias("away_on_target"),
        F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(goal, F.struct("sequence", F.concat_ws(":", "minute", "player_id", F.when(c("is_own_goal"), "own").otherwise("goal")).alias("t")))), lambda x: x.isNotNull())), lambda x: x["t"]), ",").alias("timeline"),
    )
    # The busiest player, the smallest id on a tie.
    busy = events.groupBy("match_id", "player_id").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.max_by("player_id", F.struct("n", -c("player_id"))).alias("busiest"))
    squads = played.groupBy("match_id").agg(
        F.count_if("is_starter").alias("starters"), F.count_if(~c("is_starter")).alias("others"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("is_starter"), c("player_id")))), lambda x: x.cast("string")), ",").alias("lineup"),
    )
    base = matches.select("match_id", "competition_id", "season", "status", "home_team_id", "away_team_id", "home_score", "away_score")
    whole = base.join(ledger, "match_id", "left").join(busy, "match_id", "left").join(squads, "match_id", "left")
    counts = ["n_events", "home_shots", "away_shots", "home_on_target", "away_on_target", "starters", "others"]
    coverage = F.when(c("n_events").isNull(), "result only").when(c("timeline") == "", "events without goals").otherwise("events")
    return whole.select(*base.columns, *[F.coalesce(c(x), F.lit(0).cast("long")).alias(x) for x in counts], F.coalesce("timeline", F.lit("")).alias("timeline"), F.coalesce("lineup", F.lit("")).alias("lineup"), "busiest", coverage.alias("coverage"))


def player_seasons(events: DataFrame, played: DataFrame, matches: DataFrame) -> DataFrame:
    """A player's season in a competition: appearances, minutes, counts, rates and main team."""
    m = matches.select("match_id", "competition_id", "season")
    keys = ["competition_id", "season", "player_id"]
    time = played.join(m, "match_id").groupBy(*keys, "team_id").agg(F.count("*").alias("a"), F.count_if("is_starter").alias("s"), F.sum("minutes").alias("t"))
    time = time.groupBy(*keys).agg(F.sum("a").alias("appearances"), F.sum("s").alias("starts"), F.sum("t").alias("minutes"), F.max_by("team_id", F.struct("t", -c("team_id"))).alias("team_id"))
    sums = events.join(m, "match_id").groupBy(*keys).agg(F.count_if("is_goal").alias("goals"), F.count_if(c("event_type") == "shot").alias("shots"), F.count_if((c("event_type") == "pass") & (c("outcome") == "success")).alias("passes"))
    per90 = lambda x: ratio(c(x) * 90, c("minutes")).alias(f"{x}_per90")
    return time.join(sums, keys).select("*", per90("goals"), per90("shots"), per90("passes"))


def directory(profiles: DataFrame, players: DataFrame, *, sort: str = "minutes", needle: str = "", least_minutes: int = 450, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the directory of players: by name, in order of a count, or leaders of a rate among qualified players.

    Rate leaders are defined within one competition and season; each has a place and a percentile there.
    """
    named = profiles.join(players, "player_id")
    if len(needle) >= 2:
        named = named.where(F.contains(F.lower("name"), F.lit(needle.lower())))
    pool = ("competition_id", "season")
    if sort.endswith("_per90"):
        named = mid_rank_percentile(named.where((c("minutes") >= least_minutes) & c(sort).isNotNull()), sort, *pool)
    else:
        named = named.withColumn("percentile", F.lit(None).cast("long"))
    order = Window.partitionBy(*pool).orderBy(F.desc_nulls_last(sort), F.desc("minutes"), "name", "player_id")
    placed = named.withColumn("place", F.row_number().over(order)).where((c("place") > max(0, min(5000, offset))) & (c("place") <= max(0, min(5000, offset)) + max(1, min(100, limit))))
    return placed.select(*pool, "place", "player_id", "name", "team_id", "minutes", c(sort).cast("double").alias("value"), (c("minutes") >= least_minutes).alias("qualified"), "percentile")


def player_load(apps: DataFrame) -> DataFrame:
    """Load of a player before each match that names them: (player_id, match_id, day, minutes, started, came_on, team_kind).

    Earlier days only: minutes of 7, 14 and 21 days, starts, long appearances, unused on the bench, starts in a row.
    """
    back = lambda d: Window.partitionBy("player_id").orderBy("day").rangeBetween(-d, -1)
    ever = Window.partitionBy("player_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    total = lambda x, d: F.coalesce(F.sum(x).over(back(d)), F.lit(0)).cast("long")
    one = lambda p: F.when(p, 1).otherwise(0)
    # Starts in a row: matches after the last one without a start, by its place among the player's matches.
    numbered = apps.withColumn("k", F.row_number().over(Window.partitionBy("player_id").orderBy("day", "match_id")))
    staged = numbered.select(
        "*",
        *[total("minutes", d).alias(f"minutes_{d}") for d in (7, 14, 21)],
        total(one(c("started")), 21).alias("starts_21"), total(one(c("started") | c("came_on")), 21).alias("appearances_21"),
        total(one(c("minutes") >= 75), 21).alias("long_21"), total(one(~c("started") & ~c("came_on")), 21).alias("unused_21"),
        total(one((c("team_kind") == "national") & (c("started") | c("came_on"))), 21).alias("national_21"),
        F.count("*").over(ever).alias("seen"), F.max(F.when(~c("started"), c("k"))).over(ever).alias("missed_k"),
    )
    out = ["minutes_7", "minutes_14", "minutes_21", "starts_21", "appearances_21", "long_21", "unused_21", "national_21"]
    return staged.select("player_id", "match_id", *out, (c("seen") - F.coalesce("missed_k", F.lit(0))).cast("long").alias("starts_in_a_row"))


def eleven_load(load: DataFrame, starters: DataFrame, team_matches: DataFrame) -> DataFrame:
    """Share of the last fortnight's team minutes that a match's starters had: (match_id, team_id, player_id), (match_id, team_id, last_14)."""
    per = starters.join(load.select("player_id", "match_id", "minutes_14", "national_21"), ["player_id", "match_id"]).join(team_matches, ["match_id", "team_id"])
    share = F.least(F.lit(1.0), c("minutes_14") / (90 * F.greatest(F.lit(1), c("last_14"))))
    sums = per.groupBy("match_id", "team_id").agg(F.count("*").alias("starters"), F.avg(half_up(share, 2)).alias("mean_share"), F.count_if(c("national_21") > 0).alias("returning"))
    index = 0.8 * c("mean_share") + 0.2 * F.least(F.lit(1.0), c("returning") / 4)
    return sums.select("match_id", "team_id", "starters", half_up(c("mean_share"), 4).alias("mean_share"), "returning", half_up(index * 100, 2).alias("load"))


def readiness(lineups: DataFrame, now: int) -> DataFrame:
    """State of a match's line-ups: (match_id, kickoff, home_starters, away_starters, home_at, away_at, cleared, failed), times in days.

    Confirmed: both elevens captured before kickoff from a cleared source; partial: one side, or fewer
    players; a record after kickoff: nothing before it; else unavailable, with a reason.
    """
    public = lambda s: c("cleared") & c(f"{s}_at").isNotNull() & (c(f"{s}_at") < c("kickoff"))
    home, away = F.coalesce(public("home"), F.lit(False)), F.coalesce(public("away"), F.lit(False))
    stored = lambda s: c(f"{s}_starters").isNotNull()
    late = lambda s: ~stored(s) | c(f"{s}_at").isNull() | (c(f"{s}_at") >= c("kickoff"))
    state = (
        F.when(home & away & (c("home_starters") == 11) & (c("away_starters") == 11), "CONFIRMED")
        .when(home | away, "PARTIAL")
        .when((stored("home") | stored("away")) & late("home") & late("away") & (F.lit(now) >= c("kickoff")), "POST_KICKOFF_RECORD")
        .otherwise("UNAVAILABLE")
    )
    reason = F.when(state == "PARTIAL", "PARTIAL_XI").when(state != "UNAVAILABLE", F.lit(None).cast("string")).when(~c("cleared"), "NO_CLEARED_SOURCE").when(c("failed"), "PROVIDER_ERROR").otherwise("NOT_YET_PUBLISHED")
    return lineups.select("match_id", state.alias("state"), reason.alias("reason"))


def season_depth(table: DataFrame, profiles: DataFrame) -> DataFrame:
    """A team's season: its place and counts, and the depth of its observed squad."""
    squad = profiles.groupBy("competition_id", "season", "team_id").agg(F.count("*").alias("used"), F.count_if(c("starts") > 0).alias("started"), F.count_if(c("minutes") >= 450).alias("regulars"), F.sum("goals").alias("squad_goals"), F.max_by("player_id", F.struct("goals", "minutes", -c("player_id"))).alias("top_scorer"))
    return table.join(squad, ["competition_id", "season", "team_id"], "left")


def groups_index(standings: DataFrame) -> DataFrame:
    """Tier of each competition by how many of its seasons are verified: (competition_id, season, verified)."""
    sums = standings.groupBy("competition_id").agg(F.count("*").alias("seasons"), F.count_if("verified").alias("verified"))
    tier = F.when(c("verified") == c("seasons"), "verified").when(c("verified") > 0, "partly verified").otherwise("source only")
    return sums.withColumn("tier", tier)


def swings(goals: DataFrame) -> DataFrame:
    """What each goal did to the score: (home_before, away_before, home_score, away_score)."""
    before, after = c("home_before") - c("away_before"), c("home_score") - c("away_score")
    kind = (
        F.when(after == 0, "equaliser").when((before == 0) & (c("home_before") + c("away_before") == 0), "opener").when(before == 0, "lead taken")
        .when((F.signum(before) != F.signum(after)), "turned").when(F.abs(after) > F.abs(before), "lead extended").otherwise("lead cut")
    )
    return goals.select("match_id", "sequence", kind.alias("swing"))


def season_inputs(matches: DataFrame, events: DataFrame, as_of: int) -> DataFrame:
    """What a season's profiles may read as of a day: finished matches of earlier days, and their events of one family each, the richest that tells of goals or shots.

    One row for each season: matches, the days they span, and the events by what they are. The day itself
    and all later ones are left out, so profiles of a day are the same whatever is added after it.
    """
    done = matches.where((c("status") == "finished") & (c("day") < as_of)).select("match_id", "competition_id", "season", "day")
    goal, own, shot, card = c("is_goal"), c("is_own_goal"), c("event_type") == "shot", c("card").isNotNull()
    rank = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), c("source_family"))
    told = events.select("match_id", "player_id", "is_goal", "is_own_goal", "event_type", "card", rank.alias("rank")).where(goal | own | shot | card)
    best = F.min(F.when(goal | own | shot, c("rank"))).over(Window.partitionBy("match_id"))
    picked = told.withColumn("best", best).where(c("best").isNull() | (c("rank") == c("best")))
    sums = picked.groupBy("match_id").agg(*[F.count_if(x).alias(k) for k, x in (("goals", goal), ("own_goals", own), ("shots", shot), ("cards", card))])
    both = done.join(sums, "match_id", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x)
    return both.groupBy("competition_id", "season").agg(F.count("*").alias("matches"), F.min("day").alias("first_day"), F.max("day").alias("cutoff"), F.count("goals").alias("with_events"), *[total(x) for x in ("goals", "own_goals", "shots", "cards")])

"""Team and player profiles, load, and matchups from weighted components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, ratio
from .ordered import at_ranks
from .results import tally

c = F.col


def weighted(components: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the components by weight; missing ones are left out and the weights made up for; missing if all are."""
    parts = F.array(*[F.struct(v.cast("double").alias("v"), F.lit(w).alias("w")) for v, w in components.values()])
    known = F.filter(parts, lambda p: p["v"].isNotNull())
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda a, p: a + f(p))
    return F.try_divide(total(lambda p: p["v"] * p["w"]), total(lambda p: p["w"]))


#: Metrics of a team's season that get percentiles, and those of which less is better.
TEAM_METRICS = [
    "points_per_match", "goals_for_per_match", "goals_against_per_match", "clean_sheet_rate", "failed_to_score_rate", "scored_first_rate", "points_per_match_after_conceding_first", "shots_per_match", "shots_against_per_match",
    "shots_on_target_per_match", "shot_conversion", "possession_avg", "cards_per_match", "home_points_per_match", "away_points_per_match", "last5_points_per_match",
]
LESS_IS_BETTER = ("goals_against_per_match", "failed_to_score_rate", "shots_against_per_match", "cards_per_match")


def team_season(rows: DataFrame, firsts: DataFrame, stats: DataFrame, last: int = 5, form: int = 10) -> DataFrame:
    """A team's season in sixteen metrics, with counts and form.

    rows: team rows of matches; firsts: (match_id, team_id) that the first goal counted for; stats: (match_id,
    team_id, shots, shots_on_target, possession, cards). Shots count where both teams have them; cards count a
    red one twice. Rates without matches are missing.
    """
    key = ["competition_id", "season", "team_id"]
    newest = Window.partitionBy(*key).orderBy(F.desc("day"), F.desc("match_id"))
    other = stats.select("match_id", c("team_id").alias("opponent_id"), c("shots").alias("shots_against"))
    all_rows = rows.withColumn("k", F.row_number().over(newest)).join(firsts.select("match_id", c("team_id").alias("first_team")), "match_id", "left").join(stats, ["match_id", "team_id"], "left").join(other, ["match_id", "opponent_id"], "left")
    both = c("shots").isNotNull() & c("shots_against").isNotNull()
    scored_first, conceded_first = c("first_team") == c("team_id"), c("first_team") != c("team_id")
    total = lambda x, when=None: F.coalesce(F.sum(x if when is None else F.when(when, x)), F.lit(0)).cast("long")
    letter = F.when(c("points") == 3, "W").when(c("points") == 1, "D").otherwise("L")
    sums = all_rows.groupBy(*key).agg(
        F.count("*").alias("played"), total(c("points")).alias("points"), total(c("gf")).alias("gf"), total(c("ga")).alias("ga"), F.count_if(c("ga") == 0).alias("clean_sheets"), F.count_if(c("gf") == 0).alias("scoreless"),
        F.count_if(scored_first).alias("scored_first"), F.count_if(conceded_first).alias("conceded_first"), total(c("points"), conceded_first).alias("points_behind"), F.count_if(conceded_first & (c("points") == 3)).alias("comebacks"),
        F.count_if(both).alias("stats_matches"), total(c("shots"), both).alias("shots"), total(c("shots_against"), both).alias("shots_against"), total(c("shots_on_target"), both).alias("on_target"), F.avg(F.when(both, c("possession"))).alias("possession"), total(c("cards")).alias("cards"),
        F.count_if("is_home").alias("home_played"), total(c("points"), c("is_home")).alias("home_points"), F.count_if(~c("is_home")).alias("away_played"), total(c("points"), ~c("is_home")).alias("away_points"),
        F.count_if(c("k") <= last).alias("last_played"), total(c("points"), c("k") <= last).alias("last_points"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("k") <= form, F.struct("k", letter.alias("r"))))), lambda x: x["r"]), "").alias("form"),
    )
    per = lambda a, b: ratio(c(a), c(b), 2)
    rates = {
        "points_per_match": per("points", "played"), "goals_for_per_match": per("gf", "played"), "goals_against_per_match": per("ga", "played"), "clean_sheet_rate": per("clean_sheets", "played"), "failed_to_score_rate": per("scoreless", "played"),
        "scored_first_rate": ratio(c("scored_first"), c("scored_first") + c("conceded_first"), 2), "points_per_match_after_conceding_first": per("points_behind", "conceded_first"), "shots_per_match": per("shots", "stats_matches"),
        "shots_against_per_match": per("shots_against", "stats_matches"), "shots_on_target_per_match": per("on_target", "stats_matches"), "shot_conversion": F.when(c("stats_matches") > 0, per("gf", "shots")), "possession_avg": half_up(c("possession"), 2),
        "cards_per_match": per("cards", "played"), "home_points_per_match": per("home_points", "home_played"), "away_points_per_match": per("away_points", "away_played"), "last5_points_per_match": per("last_points", "last_played"),
    }
    return sums.select(*key, "played", "points", "gf", "ga", "comebacks", "conceded_first", "stats_matches", "form", *[x.alias(k) for k, x in rates.items()])


#: Shares of the fatigue index, and what counts as a full value of each part.
FATIGUE = {"congestion": (0.35, 5), "short_rest": (0.25, 3), "rest": (0.25, 4), "away": (0.1, 1), "switching": (0.05, 3)}
REST_DAYS, SHORT_REST = 6, 4


def team_load(matches: DataFrame, last: int = 5) -> DataFrame:
    """Load and fatigue of both teams as of the day of each match, from finished matches of earlier days.

    matches: match_id, competition_id, day, home_team_id, away_team_id, status, duration. A team's matches
    are summed by day; all measures are frames over those days, but for the last matches, whose own
    frames are carried from the latest one. The index weighs five parts, each from 0 to 1; ``load`` is
    the sum of the parts' contributions, from 0 to 100, rounded.
    """
    side = lambda team, away: F.struct(c(team).alias("team_id"), F.lit(away).alias("away"))
    rows = matches.select("match_id", "competition_id", "day", "status", "duration", F.explode(F.array(side("home_team_id", 0), side("away_team_id", 1))).alias("s")).select("match_id", "competition_id", "day", "status", "duration", "s.*")
    order = Window.partitionBy("team_id").orderBy("day", "match_id")
    back = lambda k: order.rowsBetween(-k, 0)
    done = rows.where("status = 'finished'").select("*", (c("day") - F.lag("day").over(order)).alias("gap"), (c("competition_id") != F.lag("competition_id").over(order)).cast("int").alias("switch"))
    done = done.select("*", F.count("*").over(back(last - 1)).alias("recent"), F.sum("away").over(back(last - 1)).alias("recent_away"), F.coalesce(F.sum("switch").over(back(last - 2)), F.lit(0)).alias("switches"))
    short = (c("gap") < SHORT_REST).cast("int")
    by_day = done.groupBy("team_id", "day").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(short, F.lit(0))).alias("shorts"), F.min_by(F.coalesce(short, F.lit(0)), "match_id").alias("first_short"), F.count_if(c("duration").isin("extra_time", "penalties")).alias("extra"),
        F.max_by(F.struct("match_id", "recent", "recent_away", "switches"), "match_id").alias("latest"),
    )
    ahead = rows.where("status = 'scheduled'").groupBy("team_id", "day").agg(F.min("match_id").alias("next_id"))
    days = rows.select("team_id", "day").distinct().join(by_day, ["team_id", "day"], "left").join(ahead, ["team_id", "day"], "left")
    w = Window.partitionBy("team_id").orderBy("day")
    within = lambda k: w.rangeBetween(-k, -1)
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    count = lambda x, k: F.coalesce(F.sum(x).over(within(k)), F.lit(0))
    # The first match of the window has its earlier one outside.
    turnarounds = count("shorts", 21) - F.coalesce(F.first("first_short", ignorenulls=True).over(within(21)), F.lit(0))
    known = days.select(
        "team_id", "day", *[count("n", k).alias(f"matches_{k}") for k in (7, 14, 21)], turnarounds.alias("short_rest"), count("extra", 21).alias("extra_time"),
        F.max(F.when(c("n") > 0, c("day"))).over(earlier).alias("last_day"), F.last("latest", ignorenulls=True).over(earlier).alias("latest"), F.min(F.when(c("next_id").isNotNull(), F.struct("day", "next_id"))).over(later).alias("next"),
    )
    known = known.select(
        "team_id", "day", "matches_7", "matches_14", "matches_21", "short_rest", "extra_time", (c("day") - c("last_day")).alias("days_since_last"), c("latest.match_id").alias("last_match_id"),
        ratio(c("latest.recent_away"), c("latest.recent"), 2).alias("away_share"), F.coalesce("latest.switches", F.lit(0)).cast("long").alias("switches"), c("next.next_id").alias("next_match_id"), (c("next.day") - c("last_day")).alias("rest_before_next"),
    )
    rest = F.coalesce("rest_before_next", "days_since_last")
    values = {"congestion": c("matches_14"), "short_rest": c("short_rest"), "rest": F.coalesce(REST_DAYS - rest, F.lit(0)), "away": F.coalesce("away_share", F.lit(0.0)), "switching": c("switches")}
    part = lambda k: half_up(100 * FATIGUE[k][0] * F.least(F.greatest(values[k] / FATIGUE[k][1], F.lit(0.0)), F.lit(1.0)), 2)
    parts = known.select("*", *[part(k).alias(f"from_{k}") for k in FATIGUE])
    index = parts.withColumn("load", F.floor(sum((c(f"from_{k}") for k in FATIGUE), F.lit(0.0)) + 0.5).cast("long"))
    return rows.select("match_id", "team_id", "day").join(index, ["team_id", "day"])


def recent_profile(rows: DataFrame, last: int = 8) -> DataFrame:
    """Means over the last matches of earlier days, for each match; matches of one day don't see each other.

    A team's days are rows of their own, so a frame of ``last`` days holds the last matches; of the
    earliest of those days the later matches count.
    """
    days = rows.groupBy("team_id", "day").agg(F.array_sort(F.collect_list(F.struct("match_id", "is_home", "gf", "ga", "points"))).alias("own"))
    back = Window.partitionBy("team_id").orderBy("day").rowsBetween(-last, -1)
    seen = days.withColumn("seen", F.flatten(F.collect_list("own").over(back)))
    seen = seen.withColumn("seen", F.slice("seen", F.greatest(F.size("seen") - last + 1, F.lit(1)), F.lit(last)))
    n = F.size("seen").cast("long")
    mean = lambda x: F.when(n > 0, F.aggregate("seen", F.lit(0).cast("long"), lambda a, m: a + m[x]) / n)
    known = seen.select("team_id", "own", n.alias("n"), mean("gf").alias("attack"), mean("ga").alias("conceded"), mean("points").alias("form"))
    return known.select("team_id", F.explode("own").alias("m"), "n", "attack", "conceded", "form").select("m.match_id", "team_id", "m.is_home", "n", "attack", "conceded", "form")


def matchup(rows: DataFrame, least: int = 3) -> DataFrame:
    """The home side's edge in a match from both sides' recent profiles: components renormalised where one is missing."""
    p = recent_profile(rows)
    known = lambda x: F.when(c("n") >= least, c(x))
    side = lambda home, tag: p.where(c("is_home") == F.lit(home)).select("match_id", *[known(x).alias(f"{tag}_{x}") for x in ("attack", "conceded", "form")])
    both = side(True, "h").join(side(False, "a"), "match_id")
    edge = weighted({"attack": (c("h_attack") - c("a_attack"), 0.5), "defence": (c("a_conceded") - c("h_conceded"), 0.3), "form": (c("h_form") - c("a_form"), 0.2)})
    return both.select("match_id", half_up(edge, 4).alias("edge"))


def top_components(rows: DataFrame, k: int = 2) -> DataFrame:
    """The components of a match's edge that weigh most, either way."""
    p = recent_profile(rows)
    side = lambda home, tag: p.where(c("is_home") == F.lit(home)).select("match_id", *[c(x).alias(f"{tag}_{x}") for x in ("attack", "conceded", "form")])
    both = side(True, "h").join(side(False, "a"), "match_id")
    each = both.select("match_id", F.explode(F.array(*[F.struct(F.lit(x).alias("component"), half_up(c(f"h_{x}") - c(f"a_{x}"), 6).alias("edge")) for x in ("attack", "conceded", "form")])).alias("e")).select("match_id", "e.*").where("edge is not null")
    order = Window.partitionBy("match_id").orderBy(F.desc(F.abs("edge")), "component")
    return each.withColumn("place", F.row_number().over(order)).where(c("place") <= k)


def eleven_overlap(events: DataFrame) -> DataFrame:
    """How many players of a team's match also played its match before: of an earlier day, or of the same day with a smaller id."""
    squads = events.groupBy("team_id", "day", "match_id").agg(F.collect_set("player_id").alias("squad"))
    before = F.lag("squad").over(Window.partitionBy("team_id").orderBy("day", "match_id"))
    staged = squads.withColumn("before", before)
    return staged.where("before is not null").select("team_id", "match_id", F.size(F.array_intersect("squad", "before")).cast("long").alias("shared"), F.size("squad").cast("long").alias("used"))


def minute_share(played: DataFrame, top: int = 11) -> DataFrame:
    """Share of a team's minutes that its most used players have."""
    sums = played.groupBy("team_id", "player_id").agg(F.sum("minutes").alias("minutes"))
    order = Window.partitionBy("team_id").orderBy(F.desc("minutes"), "player_id")
    ranked = sums.withColumn("k", F.row_number().over(order))
    return ranked.groupBy("team_id").agg(F.count("*").alias("players"), ratio(F.sum(F.when(c("k") <= top, c("minutes"))), F.sum("minutes")).alias("share"))


def collapsed_runs(events: DataFrame) -> DataFrame:
    """A player's teams in order, repeats in a row taken as one."""
    order = Window.partitionBy("player_id").orderBy("day", "match_id", "sequence")
    turns = events.select("player_id", "team_id", "day", "match_id", "sequence", F.lag("team_id").over(order).alias("before")).where("before is null or before <> team_id")
    return turns.groupBy("player_id").agg(F.count("*").alias("spells"))


def terciles(df: DataFrame, value: str, *pool: str) -> DataFrame:
    """Values at a third and two thirds of a sorted pool."""
    return at_ranks(df, value, {"lower": F.floor(c("n") / 3.0), "upper": F.floor(c("n") * (2 / 3.0))}, *pool).drop("n")


def nearest_percentiles(df: DataFrame, value: str, shares: dict[str, float], *pool: str, least: int = 1) -> DataFrame:
    """Values at the nearest ranks of shares of (n - 1), for pools of ``least`` rows or more."""
    return at_ranks(df, value, {name: F.floor(q * (c("n") - 1) + 0.5) for name, q in shares.items()}, *pool).where(c("n") >= least).drop("n")


def split_points(rows: DataFrame) -> DataFrame:
    return tally(rows, "team_id", "is_home").select("team_id", "is_home", "played", "points")

"""Results: team rows, tables, form, streaks, gaps, head-to-head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


def team_match(matches: DataFrame) -> DataFrame:
    """Two rows per finished match, one for each side; the matches are read once."""
    done = matches.where("status = 'finished'")
    side = lambda team, other, home, gf, ga: F.struct(F.col(team).alias("team_id"), F.col(other).alias("opponent_id"), F.lit(home).alias("is_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    sides = F.array(side("home_team_id", "away_team_id", True, "home_score", "away_score"), side("away_team_id", "home_team_id", False, "away_score", "home_score"))
    rows = done.select("match_id", "competition_id", "season", "day", F.explode(sides).alias("s")).select("match_id", "competition_id", "season", "day", "s.*")
    return rows.withColumn("points", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    """Played, won, drawn, lost, goals and points by keys."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("played"),
        n(F.col("points") == 3).alias("won"),
        n(F.col("points") == 1).alias("drawn"),
        n(F.col("points") == 0).alias("lost"),
        F.sum("gf").cast("long").alias("gf"),
        F.sum("ga").cast("long").alias("ga"),
        (F.sum("gf") - F.sum("ga")).cast("long").alias("gd"),
        F.sum("points").cast("long").alias("points"),
    )


#: Orders of equal rank candidates, the team's id last so that every order is total.
TIEBREAKS = {"goals": ["points", "gd", "gf"], "wins": ["points", "won", "gd", "gf"]}


def league_table(rows: DataFrame, tiebreak: str = "goals", keys: tuple[str, ...] = ("competition_id", "season")) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in TIEBREAKS[tiebreak]], "team_id")
    return tally(rows, *keys, "team_id").withColumn("position", F.row_number().over(order))


def letter() -> Column:
    return F.when(F.col("points") == 3, "W").when(F.col("points") == 1, "D").otherwise("L")


def form(rows: DataFrame, last: int = 5, keys: tuple[str, ...] = ("competition_id", "season", "team_id")) -> DataFrame:
    """The last results, newest first."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("day"), F.desc("match_id"))
    recent = rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= last)
    listed = F.array_sort(F.collect_list(F.struct("k", letter().alias("r"))))
    return recent.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["r"]), "").alias("form"))


def cumulative(rows: DataFrame) -> DataFrame:
    """Points and goal difference of a team after each match of a season."""
    so_far = Window.partitionBy("competition_id", "season", "team_id").orderBy("day", "match_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "competition_id", "season", "team_id", "match_id",
        F.count("*").over(so_far).alias("played"),
        F.sum("points").over(so_far).cast("long").alias("points"),
        F.sum(F.col("gf") - F.col("ga")).over(so_far).cast("long").alias("gd"),
    )


def trailing_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """Lengths of the runs that reach up to a team's last match: winning, unbeaten, losing, winless."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("day"), F.desc("match_id"))
    ranked = rows.withColumn("k", F.row_number().over(newest))
    broken = lambda c: F.coalesce(F.min(F.when(~c, F.col("k"))) - 1, F.max("k")).cast("long")
    p = F.col("points")
    return ranked.groupBy(*keys).agg(broken(p == 3).alias("winning"), broken(p > 0).alias("unbeaten"), broken(p == 0).alias("losing"), broken(p < 3).alias("winless"))


def rest(rows: DataFrame) -> DataFrame:
    """Days since a team's earlier match, and its matches in the 7, 14 and 21 days before (the day itself left out)."""
    order = Window.partitionBy("team_id").orderBy("day", "match_id")
    within = lambda k: F.count("*").over(Window.partitionBy("team_id").orderBy("day").rangeBetween(-k, -1)).alias(f"last_{k}")
    return rows.select("match_id", "team_id", "day", "is_home", (F.col("day") - F.lag("day").over(order)).alias("gap"), within(7), within(14), within(21))


def venue_switches(rows: DataFrame, last: int = 5) -> DataFrame:
    """Changes between home and away among a team's last matches."""
    newest = Window.partitionBy("team_id").orderBy(F.desc("day"), F.desc("match_id"))
    recent = rows.select("team_id", "is_home", F.row_number().over(newest).alias("k"), F.lead("is_home").over(newest).alias("earlier"))
    return recent.where(F.col("k") < last).groupBy("team_id").agg(F.count_if(F.col("is_home") != F.col("earlier")).alias("switches"))


def results_split(rows: DataFrame) -> DataFrame:
    """Totals and rates of a team: all, home and away."""
    each = rows.select("*", F.explode(F.array(F.lit("all"), F.when(F.col("is_home"), "home").otherwise("away"))).alias("venue"))
    sums = tally(each, "team_id", "venue")
    return sums.select("*", ratio(F.col("won"), F.col("played")).alias("win_rate"), ratio(F.col("gf"), F.col("played")).alias("gf_rate"), ratio(F.col("points"), F.col("played")).alias("points_rate"))


def head_to_head(matches: DataFrame, last: int = 12) -> DataFrame:
    """The last meetings of every pair of teams, whoever was at home."""
    pair = [F.least("home_team_id", "away_team_id").alias("team_a"), F.greatest("home_team_id", "away_team_id").alias("team_b")]
    done = matches.where("status = 'finished'").select("match_id", "day", "home_team_id", "home_score", "away_score", *pair)
    order = Window.partitionBy("team_a", "team_b").orderBy(F.desc("day"), F.desc("match_id"))
    recent = done.withColumn("k", F.row_number().over(order)).where(F.col("k") <= last)
    a_home = F.col("home_team_id") == F.col("team_a")
    margin = F.when(a_home, F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score"))
    return recent.withColumn("margin", margin).groupBy("team_a", "team_b").agg(
        F.count("*").alias("meetings"), F.count_if(F.col("margin") > 0).alias("a_won"), F.count_if(F.col("margin") == 0).alias("drawn"), F.count_if(F.col("margin") < 0).alias("b_won")
    )


def table_move(rows: DataFrame, day: int, keys: tuple[str, ...] = ("competition_id", "season")) -> DataFrame:
    """Positions before a day and up to it, for teams in both tables."""
    columns = [*keys, "team_id"]
    before = league_table(rows.where(F.col("day") < day), keys=keys).select(*columns, F.col("position").alias("before"), F.col("points").alias("points_before"))
    after = league_table(rows.where(F.col("day") <= day), keys=keys).select(*columns, F.col("position").alias("after"), F.col("points").alias("points_after"))
    return before.join(after, columns).withColumn("moved", F.col("before") - F.col("after"))


def next_fixture(matches: DataFrame, day: int) -> DataFrame:
    """Each team's first scheduled match after a day."""
    ahead = matches.where((F.col("status") == "scheduled") & (F.col("day") > day))
    sides = ahead.select("match_id", "day", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    first = F.min(F.struct("day", "match_id"))
    return sides.groupBy("team_id").agg(first.alias("f")).select("team_id", F.col("f.day").alias("day"), F.col("f.match_id").alias("match_id"))

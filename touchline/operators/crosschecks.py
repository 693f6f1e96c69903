"""Crosswalks, guards, preferences between sources, and smaller statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fold, half_up
from ..sources.shared import written
from .ordered import at_ranks, before

c = F.col
#: Pieces over which the pairs of one name and birth day are dealt.
PIECES = 8


def resolved(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Canonical ids by (provider, external_id); rows without one keep a null."""
    return rows.join(crosswalk.select("provider", "external_id", "canonical_id"), ["provider", "external_id"], "left")


def several_ids(crosswalk: DataFrame) -> DataFrame:
    """Canonical entities with more than one id of a provider."""
    return crosswalk.groupBy("provider", "canonical_id").agg(F.count("*").alias("n")).where("n > 1")


def same_person(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates with one folded name and one birth day: (id, name, born) both; unique on both sides, or ambiguous."""
    left = a.select(c("id").alias("a_id"), fold(c("name")).alias("key"), "born")
    right = b.select(c("id").alias("b_id"), fold(c("name")).alias("key"), "born")
    # Partners are counted by name and birth day, so the pairs themselves are neither shuffled nor sorted.
    sizes = lambda rows: rows.groupBy("key", "born").agg(F.count("*").alias("n"))
    alone = lambda rows, others, id_: rows.join(sizes(others), ["key", "born"]).withColumn(f"{id_}_alone", F.sum("n").over(Window.partitionBy(id_)) == 1).drop("n")
    # A group's pairs are dealt over pieces of its left rows, in a fixed number of parts: few rows go in, many come out.
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = alone(left, right, "a_id").withColumn("piece", F.pmod(F.hash("a_id"), F.lit(PIECES)))
    others = alone(right, left, "b_id").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    dealt = lambda rows: rows.repartition(parts, "key", "born", "piece")
    met = dealt(mine).join(dealt(others), ["key", "born", "piece"])
    return met.select("a_id", "b_id", (c("a_id_alone") & c("b_id_alone")).alias("unique"))


def preferred(stats: DataFrame) -> DataFrame:
    """One value per (match, team, stat): a source's value before a derived one."""
    return stats.groupBy("match_id", "team_id", "stat_key").agg(F.max_by("value", F.struct((c("basis") == "source").alias("s"), c("value"))).alias("value"), F.max(c("basis") == "source").alias("from_source"))


def coverage_tier(parts: DataFrame, most: float = 0.9) -> DataFrame:
    """Highest tier of a season whose components, and all below, cover the share: (key, n, with_teams, with_lineups, with_stats, with_events)."""
    ok = lambda x: c(x) >= most * c("n")
    tier = F.when(~ok("with_teams"), "results").when(~ok("with_lineups"), "match").when(~ok("with_stats"), "lineup").when(~ok("with_events"), "stats").otherwise("events")
    return parts.withColumn("tier", tier)


def zip_agrees(a: Column, b: Column) -> Column:
    """Whether two ordered lists agree item by item."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: same)


def streak_up_to_last(rows: DataFrame, key: str, order: list[str], good: Column) -> DataFrame:
    """Rows in a row, counted back from the last, for which ``good`` holds."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(x) for x in order])
    ranked = rows.select(key, good.alias("good"), F.row_number().over(newest).alias("k"))
    return ranked.groupBy(key).agg(F.coalesce(F.min(F.when(~c("good"), c("k"))) - 1, F.max("k")).cast("long").alias("streak"))


def lead_times(df: DataFrame, hours: Column, *keys: str) -> DataFrame:
    """Least, median (lower) and most of a duration."""
    ranks = {"least": F.lit(0), "median": F.floor((c("n") - 1) / 2), "most": c("n") - 1}
    return at_ranks(df.select(*keys, hours.alias("h")), "h", ranks, *keys).drop("n")


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Rank correlation; equal values share the mean of their ranks."""
    mean_rank = lambda v: F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2.0
    ranked = df.select(*keys, mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    return ranked.groupBy(*keys).agg(half_up(F.corr("rx", "ry"), 6).alias("rho"))


def input_hash(rows: DataFrame, key: str, day: str, order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 over a group's days in order, each the SHA-256 of its rows in order.

    A task holds the rows of one day, and then one hash for each day of a group.
    """
    each = F.struct(*[c(x) for x in order], F.concat_ws("|", *[c(f).cast("string") for f in fields]).alias("line"))
    digest = lambda lines: F.sha2(F.array_join(lines, "\n"), 256)
    days = rows.groupBy(key, day).agg(digest(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["line"])).alias("h"), F.count("*").alias("k"))
    return days.groupBy(key).agg(digest(F.transform(F.array_sort(F.collect_list(F.struct(day, "h"))), lambda s: s["h"])).alias("hash"), F.sum("k").alias("n"))


def allocated(demands: DataFrame, pool: int) -> DataFrame:
    """Grants from a pool: every floor first, then by tier and id while it lasts: (id, tier, floor_want, want); ids are unique."""
    extra = F.greatest(c("want") - c("floor_want"), F.lit(0))
    wanted = demands.select("id", "tier", "floor_want", extra.alias("extra"))
    tiers = wanted.groupBy("tier").agg(F.sum("extra").alias("e"), F.sum("floor_want").alias("f"))  # few rows
    over = Window.partitionBy(F.lit(1)).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    tiers = tiers.select(c("tier").alias("of_tier"), F.coalesce(F.sum("e").over(over), F.lit(0)).alias("tier_before"), F.sum("f").over(Window.partitionBy(F.lit(1))).alias("floors"))
    inside = before(wanted, "id", {"extra": "extra", "floor_want": "floor_want"}, pool=("tier",))
    left = F.greatest(pool - c("floors") - c("tier_before") - c("before_extra"), F.lit(0))
    return inside.join(tiers, c("tier") == c("of_tier")).select("id", "tier", (c("floor_want") + F.least(c("extra"), left)).cast("long").alias("granted"))


def confident_accuracy(df: DataFrame, shares: list[float]) -> DataFrame:
    """Accuracy of the most confident shares of forecasts: (id, p, hit); of equal probabilities the smaller ids count first."""
    out = None
    df = written(df.select("id", "p", "hit"), "forecasts")  # read for every share
    n = df.count()
    levels = before(df.withColumn("v", -c("p")), "v", {"hits": "cast(hit as int)"})
    for share in shares:
        most = int(n * share)
        whole = levels.where(c("before_n") + c("n") <= most).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        edge = levels.where((c("before_n") < most) & (c("before_n") + c("n") > most)).select((-c("v")).alias("at"), (most - c("before_n")).alias("room"))
        tied = df.join(edge, c("p") == c("at")).select("id", "hit", "room")
        some = before(tied, "id", {"hits": "cast(hit as int)", "room": "room"}).where(c("before_n") < c("room")).agg(F.count("*").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        both = whole.unionByName(some).agg(F.sum("n").cast("long").alias("n"), F.sum("hits").alias("hits"))
        row = both.select(F.lit(share).alias("share"), "n", half_up(F.try_divide(c("hits"), c("n")), 6).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def activity(matches: DataFrame, now: int) -> DataFrame:
    """What a competition is doing on a day: live, soon, active or idle, by its nearest matches."""
    near = matches.groupBy("competition_id").agg(F.count_if(c("day") == now).alias("today"), F.count_if(c("day").between(now + 1, now + 3)).alias("soon"), F.count_if(c("day").between(now - 14, now + 14)).alias("fortnight"))
    return near.withColumn("state", F.when(c("today") > 0, "live").when(c("soon") > 0, "soon").when(c("fortnight") > 0, "active").otherwise("idle"))


def members(rows: DataFrame, key: str, member: str, wanted: int) -> DataFrame:
    """Keys that have a member, and how many members they have; only the rows of such keys are counted."""
    having = rows.where(c(member) == wanted).select(key).distinct()
    return rows.join(having, key, "left_semi").groupBy(key).agg(F.count_distinct(member).alias("n"))

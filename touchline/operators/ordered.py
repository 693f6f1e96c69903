"""Sums, ranks and pages over an order of all rows, without a task that holds them all.

Rows are cut into ranges of the order by Spark's range partitioning, whose bounds come from a
sample and hold whatever the number of rows: more shuffle partitions, smaller ranges. A window runs
within a range, and only the ranges' totals meet in another one. Ranges are written down before
they are numbered, as a repeated task could cut them at other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written

c = F.col
#: Distinct values of a rank's range that may meet in one window.
FEW = 100_000
#: Parts into which a step of ``at_ranks`` cuts a range, and the accuracy of its sketch (rank error: rows / ACCURACY).
CUTS, ACCURACY = 256, 10_000


def before(df: DataFrame, value: str, sums: dict[str, str], pool: tuple[str, ...] = ()) -> DataFrame:
    """One row per (pool, value): n, the sums of its rows, and before_n, before_<name> of all rows of the pool below it.

    Values are counted first, so repeated ones are one row. Null values have no place and are left out.
    """
    known = df.where(c(value).isNotNull())
    by_value = known.groupBy(*pool, value).agg(F.count("*").alias("n"), *[F.sum(F.expr(x)).alias(name) for name, x in sums.items()])
    names = ["n", *sums]
    placed = written(by_value.repartitionByRange(*pool, value).withColumn("piece", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*pool, "piece").agg(*[F.sum(x).alias(f"all_{x}") for x in names])
    ahead = Window.partitionBy(*pool).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[c(p).alias(f"of_{p}") for p in pool], c("piece").alias("of_piece"), *[F.coalesce(F.sum(f"all_{x}").over(ahead), F.lit(0)).alias(f"base_{x}") for x in names])
    inside = Window.partitionBy(*pool, "piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"in_{x}") for x in names])
    same = [c("piece") == c("of_piece"), *[c(p).eqNullSafe(c(f"of_{p}")) for p in pool]]
    return local.join(bases, same).select(*pool, value, *names, *[(c(f"in_{x}") + c(f"base_{x}")).alias(f"before_{x}") for x in names])


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], *pool: str, few: int = FEW) -> DataFrame:
    """Pools with ``n`` and, for each name, the value at a rank (from 0, in ascending order); exact.

    ``ranks`` are expressions over ``n``, the pool's rows with a value. While the range of a rank has
    more than ``few`` rows, a mergeable sketch of that range's quantiles says between which values the
    rank lies, and one filtered count how many rows lie below them, on them and between them, so
    no error of the sketch remains. A rank on one of the two values is found; else what is between
    them, a small share, is the next range. The few values left at last are counted and walked.
    """
    if not pool:
        return at_ranks(df.withColumn("whole", F.lit(0)), value, ranks, "whole", few=few).drop("whole")
    keys = [*pool, "name"]
    known = df.where(c(value).isNotNull()).select(*pool, c(value).alias("v"))
    sizes = known.groupBy(*pool).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    state = written(sizes.select(*pool, "low", "high", c("n").alias("inside"), wanted.alias("w")).select(*pool, "w.*", "low", "high", F.lit(0).cast("long").alias("below"), "inside"), "ranks")

    def met(rows: DataFrame) -> DataFrame:
        """The values within the ranges of ``rows``."""
        other = rows.withColumnsRenamed({p: f"of_{p}" for p in pool})
        return known.join(other, [c(p).eqNullSafe(c(f"of_{p}")) for p in pool]).where("v between low and high").drop(*[f"of_{p}" for p in pool])

    open_ranges = (c("inside") > few) & (c("low") < c("high"))
    while not state.where(open_ranges).isEmpty():
        at = F.floor((c("rank") - c("below")) / c("inside") * CUTS).cast("int")  # one cut more on both sides covers the sketch's error
        cuts = met(state.where(open_ranges)).groupBy(*keys, "rank", "below", "inside").agg(F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], ACCURACY).alias("cuts"), F.min("v").alias("low"), F.max("v").alias("high"))
        cuts = written(cuts.select(*keys, "rank", "below", "low", "high", F.get("cuts", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("cuts", F.least(at + 2, F.lit(CUTS))).alias("b")), "cuts")
        a, b, v = c("a"), c("b"), c("v")
        counts = met(cuts).groupBy(*keys, "rank", "below", "a", "b").agg(
            F.count_if(v < a).alias("under"), F.count_if(v == a).alias("on_a"), F.count_if((v > a) & (v < b)).alias("mid"), F.count_if(v == b).alias("on_b"), F.min(F.when(v > a, v)).alias("next"), F.max(F.when(v < b, v)).alias("last")
        )
        into = c("rank") - c("below") - c("under")
        on_a, on_b = into < c("on_a"), into >= c("on_a") + c("mid")
        pick = lambda x, y, z: F.when(on_a, x).when(on_b, y).otherwise(z)
        closer = counts.select(
            *keys, "rank", pick(a, b, c("next")).alias("low"), pick(a, b, c("last")).alias("high"),
            (c("below") + c("under") + pick(F.lit(0), c("on_a") + c("mid"), c("on_a"))).alias("below"), pick(c("on_a"), c("on_b"), c("mid")).alias("inside"),
        )
        state = written(state.where(~open_ranges).unionByName(closer), "ranks")
    values = met(state).groupBy(*keys, "rank", "below", "v").agg(F.count("*").alias("k"))
    upto = values.withColumn("upto", c("below") + F.sum("k").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.where(c("upto") > c("rank")).groupBy(*keys).agg(F.min("v").alias("v"))
    wide = found.groupBy(*pool).agg(*[F.max(F.when(c("name") == name, c("v"))).alias(name) for name in ranks]).withColumnsRenamed({p: f"of_{p}" for p in pool})
    return sizes.select(*pool, "n").join(wide, [c(p).eqNullSafe(c(f"of_{p}")) for p in pool], "left").select(*pool, "n", *ranks)


class Pages:
    """Rows in a total order that can be read page by page, or on from a key, without sorting again.

    The rows are sorted range by range once and written, a folder for each range, with the ranges'
    counts and first keys beside them. A page is found by the counts before it, a cursor by the first
    keys, and either reads only the folders that hold its rows. ``order`` are columns; the last ones
    must make the order total. Nulls come first.
    """

    def __init__(self, df: DataFrame, order: list[str], ranges: int | None = None):
        self.order, self.path = order, shared_folder(df.sparkSession, "pages")
        by = [c(x).asc_nulls_first() for x in order]
        cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
        sorted_rows = cut.sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
        sorted_rows.write.partitionBy("range").parquet(self.path)
        self.schema = sorted_rows.schema
        whole = df.sparkSession.read.schema(self.schema).parquet(self.path)
        counts = whole.groupBy("range").agg(F.count("*").alias("size"), F.min(F.struct(*order)).alias("first"))
        ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        self.ranges = written(counts.select("range", "size", "first", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base")), "page-ranges")
        self.whole = whole

    def placed(self) -> DataFrame:
        """All rows with ``place``, from 0; a window runs within a range."""
        inside = Window.partitionBy("range").orderBy(*[c(x).asc_nulls_first() for x in self.order])
        local = self.whole.withColumn("at", F.row_number().over(inside) - 1)
        return local.join(self.ranges.select("range", "base"), "range").withColumn("place", c("at") + c("base")).drop("at", "base", "range")

    def _read(self, ranges: list[int]) -> DataFrame:
        return self.whole.where(c("range").isin(ranges) if ranges else F.lit(False))

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0), in order, with its rows' places."""
        first, end = number * size, (number + 1) * size
        hit = self.ranges.where((c("base") < end) & (c("base") + c("size") > first)).select("range", "base").orderBy("range").collect()  # ranges of one page
        rows = self._read([r["range"] for r in hit]).orderBy(*[c(x).asc_nulls_first() for x in self.order]).offset(first - hit[0]["base"] if hit else 0).limit(size)
        return rows.drop("range")

    def after(self, key: tuple | None, size: int) -> DataFrame:
        """The first rows behind a key (all of ``order``; none: from the start), in order."""
        starts = self.ranges.select("range", "size", "first")
        if key is not None:
            last = F.struct(*[F.lit(v).cast(self.schema[x].dataType).alias(x) for x, v in zip(self.order, key)])
            # The range that the key falls into, and those behind it, as far as the page needs.
            start = starts.where(c("first") <= last).agg(F.max("range")).first()[0]
            starts = starts.where(c("range") >= (start if start is not None else 0))
        ranges, have = [], 0
        for r in starts.orderBy("range").select("range", "size").toLocalIterator():
            ranges.append(r["range"])
            have += r["size"] if len(ranges) > 1 or key is None else 0  # of the key's own range any number may lie before it
            if have >= size:
                break
        rows = self._read(ranges)
        if key is not None:
            rows = rows.where(F.struct(*self.order) > last)
        return rows.orderBy(*[c(x).asc_nulls_first() for x in self.order]).limit(size).drop("range")

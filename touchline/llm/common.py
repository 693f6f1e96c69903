"""Shared pieces of the text operators: column picking, shared scratch folders, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the complement of the word pattern [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"


#: Rows and bytes that go to a Python worker at once: whole texts can be long, and workers share an executor's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold BATCH_ROWS rows and BATCH_BYTES bytes at most.

    The settings are read when a query runs, long after this returns, so they stay; smaller
    ones of the session are kept.
    """
    for name, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", (1 << 31) - 1, BATCH_BYTES)):
        said = spark.conf.get(name, str(usual))
        if not said.isdigit() or not 0 < int(said) <= most:
            spark.conf.set(name, str(most))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``columns`` (new name = exact old name) whatever other columns there are.

    Columns are found by exact name and position, so further columns whose names
    clash with ours, or differ from the wanted one by case alone, do no harm.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    missing = [c for c in columns.values() if c not in at]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")
    plain = df.toDF(*[f"in_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"in_{at[old]}").alias(new) for new, old in columns.items()])


_own_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI; a folder of our own only where it is unset, on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _own_roots[app]
    if "://" not in root:  # as Spark reads it: on the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(column: Column | str) -> Column:
    """crc32 of a value's text as UTF-8, unsigned."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))


def with_prefix(df: DataFrame, order: str, values: list[str], chunk: int = 4096) -> DataFrame:
    """Add before_<value>: the sum of ``value`` over all rows with a smaller ``order``.

    ``order`` is a distinct integer from 0 upwards. Two levels keep every window task
    small: rows are summed by chunks of ``chunk`` orders, only the chunk totals (rows /
    chunk) meet in one window, and each chunk then adds its own running sums.
    """
    df = df.withColumn("px_chunk", F.floor(F.col(order) / chunk))
    totals = df.groupBy("px_chunk").agg(*[F.sum(v).alias(f"px_{v}") for v in values])
    ahead = Window.orderBy("px_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("px_chunk", *[F.coalesce(F.sum(f"px_{v}").over(ahead), F.lit(0)).alias(f"px_{v}") for v in values])
    inside = Window.partitionBy("px_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"in_{v}") for v in values])
    out = local.join(bases, "px_chunk")
    for v in values:
        out = out.withColumn(f"before_{v}", (F.col(f"in_{v}") + F.col(f"px_{v}")).cast("long"))
    return out.drop("px_chunk", *[f"px_{v}" for v in values], *[f"in_{v}" for v in values])

"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash into buckets small enough for memory. Pass two
gives each bucket a Fisher-Yates permutation of its places, whose draws are hashes of (seed,
bucket, step), so only places are held in arrays, never texts; buckets follow each other, and
the global place decides shard and slot. Shards are written as folders, rows in slot order.

Nothing depends on how the input is cut into partitions: the same rows and seed give the same
shards and slots. Buckets are bounded by bytes and by rows (``bucket_rows``), as a permutation
takes time with the square of its rows; tasks are sized by ``task_bytes``, to be raised for
large executors.

The ``rows`` law: counts of any two shards differ by at most one. The texts cross one
shuffle. Only DataFrame functions are used.

Defined results: null ids and texts are rows like any other; rows equal in id and text are
numbered and scattered one by one, however many there are; an empty table gives no rows;
texts of any length count with their bytes when buckets are sized; further columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, saved, scratch, with_prefix

#: Bytes of text and rows that a bucket is sized for.
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 256
#: Bytes of text that a task of pass two gets.
TASK_BYTES = 16 << 20


def size_of(text: str = "text") -> Column:
    """Bytes of a text as UTF-8 (null: none), plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def permutation(n: Column, seed: int, bucket: str) -> Column:
    """0 to n - 1 in the order of a Fisher-Yates shuffle, built from the first place on.

    Step i draws one of the places 0 to i; the value there goes to place i, and i takes its place.
    """

    def step(done: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col(bucket), i), i.cast("long") + 1).cast("int")
        before, after = F.slice(done, F.lit(1), draw), F.slice(done, draw + 2, F.greatest(i - draw - 1, F.lit(0)))
        return F.when(draw == i, F.concat(done, F.array(i))).otherwise(F.concat(before, F.array(i), after, F.slice(done, draw + 1, F.lit(1))))

    steps = F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), lambda i: i < n)
    return F.aggregate(steps, F.array().cast("array<int>"), step)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``copy``: 0, or from 0 upwards among rows equal in id and text.

    Only ids and hashes cross the shuffle that finds such rows; few texts occur twice under one id.
    """
    keyed = rows.select("*", F.xxhash64(F.lit(1), "doc_id", "text").alias("h1"), F.xxhash64(F.lit(2), "doc_id", "text").alias("h2"))
    again = saved(keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated-rows")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    single = keyed.join(again, ["h1", "h2"], "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("copy"))
    # Equal rows are one row and a count before they are shuffled.
    counted = keyed.join(again, ["h1", "h2"], "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return single.unionByName(counted.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")))


def shard_rows(
    df: DataFrame, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 20_240_229,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Shuffle the rows over ``shards`` folders below ``path`` and read them back: doc_id, text, slot, shard."""
    spark = df.sparkSession
    path = path or scratch(spark, "shards")
    rows = _numbered(pick(df, doc_id=doc_id, text=text))
    total, n = rows.select(size_of().alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(4 * shards, -(-total // bucket_bytes), -(-n // bucket_rows))
    tasks = max(1, -(-total // task_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "copy"), F.lit(buckets)))

    # The permutation of each bucket's places, with the places of all buckets before it.
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    places = with_prefix(counts, "bucket", ["n"])
    places = saved(places.select("bucket", F.col("before_n").alias("base"), permutation(F.col("n"), seed, "bucket").alias("place")), "places")

    order = Window.partitionBy("bucket").orderBy("doc_id", F.xxhash64("text"), "copy")
    numbered = rows.repartition(tasks, "bucket").withColumn("k", F.row_number().over(order) - 1)
    place = F.col("base") + F.get("place", F.col("k"))
    placed = numbered.join(places.repartition(tasks, "bucket"), "bucket").select("doc_id", "text", place.alias("p"))
    placed = placed.select("doc_id", "text", F.expr(f"cast(p * {shards} div {max(n, 1)} as int)").alias("shard"), "p")
    out = placed.select("doc_id", "text", F.expr(f"p - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"), "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = out.schema
    return spark.read.schema(schema).parquet(path)

"""A change-tracked table fed by a stream, exactly once.

A batch is diffed against the table as it stood before that batch, and leaves three things: the
rows that it wrote, a row for each changed field, and, last of all, its commit. What has no commit
doesn't exist for readers, so a batch that died half-way is written anew over its own folders, and
a batch that has its commit writes nothing when it is played again.

Rows are kept as a log by batch; a key's row is that of its last committed batch. Every
``compact`` batches the log is folded into a base, so a batch meets one base and a few batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import changes, classified

c = F.col


class TrackedTable:
    """A table below ``path`` (on storage that driver and executors share) with its keys and compared fields."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, compact: int = 20):
        self.spark, self.path, self.schema, self.keys, self.order, self.compact = spark, path.rstrip("/"), schema, keys, order, compact
        self.fields = [f.name for f in schema if f.name not in (*keys, order)]

    def _finished(self, kind: str) -> list[int]:
        """Batches whose folder of a kind was written to its end, in order."""
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch=*/_SUCCESS")
        fs = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in fs.globStatus(done) or [])

    def committed(self) -> list[int]:
        """Batches that have their commit, in order."""
        return self._finished("commits")

    def _log(self, batches: list[int]) -> DataFrame:
        """The rows of batches, from the last base among them on."""
        bases = [b for b in self._finished("base") if b in batches]
        first = bases[-1] if bases else -1
        paths = [f"{self.path}/base/batch={first}"] if bases else []
        paths += [f"{self.path}/rows/batch={b}" for b in batches if b > first]
        if not paths:
            return self.spark.createDataFrame([], StructType([*self.schema]).add("written", "long"))
        return self.spark.read.schema(StructType([*self.schema]).add("written", "long")).parquet(*paths)

    def rows(self, before: int | None = None) -> DataFrame:
        """The table as committed, or as it stood before a batch."""
        batches = [b for b in self.committed() if before is None or b < before]
        value = F.struct(*[f.name for f in self.schema if f.name not in self.keys])
        last = self._log(batches).groupBy(*self.keys).agg(F.max_by(value, "written").alias("v"))
        return last.select(*self.keys, "v.*").select(*self.schema.names)

    def changes(self) -> DataFrame:
        """Changed fields of committed batches: keys, field, old_value, new_value, written."""
        kind = StructType([f for f in self.schema if f.name in self.keys]).add("field", "string").add("old_value", "string").add("new_value", "string").add("written", "long")
        batches = [f"{self.path}/changes/batch={b}" for b in self.committed()]
        return self.spark.read.schema(kind).parquet(*batches) if batches else self.spark.createDataFrame([], kind)

    def apply(self, incoming: DataFrame, batch: int) -> bool:
        """Write a batch; False, and nothing written, if it was committed before. For ``foreachBatch``.

        Of several rows of a key within a batch the last by ``order`` counts; a row older than the
        stored one is left out, so late rows change nothing.
        """
        if batch in self.committed():
            return False
        value = F.struct(self.order, *self.fields)
        new = incoming.groupBy(*self.keys).agg(F.max(value).alias("v")).select(*self.keys, "v.*")
        stored = self.rows(before=batch)
        old_order = stored.select(*self.keys, c(self.order).alias("stored_order"))
        fresh = new.join(old_order, self.keys, "left").where(F.coalesce(c(self.order) >= c("stored_order"), F.lit(True))).drop("stored_order")
        # Only stored rows of the batch's keys take part in the comparison.
        seen = classified(stored.join(new.select(*self.keys), self.keys, "left_semi"), fresh, self.keys, self.fields)
        out = seen.where("action <> 'same'").join(fresh.select(*self.keys, self.order), self.keys)
        written = F.lit(batch).cast("bigint").alias("written")
        out.select(*[c(n) for n in self.schema.names], written).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        changes(seen, self.keys, self.fields).select(*self.keys, "field", "old_value", "new_value", written).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        counts = seen.groupBy().agg(*[F.count_if(c("action") == a).alias(a) for a in ("insert", "update", "same")]).withColumn("written", written)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        done = self.committed()
        if len([b for b in done if b > max([-1, *self._finished("base")])]) >= self.compact:
            self.rows().withColumn("written", written).write.mode("overwrite").parquet(f"{self.path}/base/batch={batch}")
        return True

    def commits(self) -> DataFrame:
        """What each committed batch did: insert, update, same, written."""
        return self.spark.read.schema("insert bigint, update bigint, same bigint, written bigint").parquet(*[f"{self.path}/commits/batch={b}" for b in self.committed()])


def follow(stream: DataFrame, table: TrackedTable, checkpoint: str) -> None:
    """Bring what is there of a stream into the table, exactly once."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: table.apply(df, batch)).start().awaitTermination()

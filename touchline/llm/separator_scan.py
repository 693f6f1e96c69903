"""Token counts by a separator scan of flat token files without an index.

A flat file holds little-endian unsigned 16-bit token ids, each document followed by an
end-of-document id that occurs nowhere else. Files are cut into blocks of equal length;
each block is searched with one vectorised comparison; a prefix scan over the blocks'
summaries (separators seen, last separator's place) then gives every document its number
and start, whatever number of blocks it spans.

Defined results: an empty file has no documents; an end id right after another, or first in
a file, is a document of no tokens; tokens after a file's last end id are a document with
``terminated`` false. A null text is written as an empty document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, saved
from .files import committed, opened
from .tokens import default_vocabulary, encoder

#: <|endoftext|> of the default vocabulary: no ordinary text has it.
END_ID = 50256
#: Ids in a block (2 bytes each).
BLOCK_IDS = 1 << 20
#: Blocks whose summaries meet in one window task at most.
CHUNK_BLOCKS = 4096


def write_flat(df: DataFrame, path: str, *, text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write each partition's documents as one flat token file below ``path``; no shuffle.

    A text that itself holds the end id's string would split in two; so such strings are
    encoded as ordinary text.
    """
    vocabulary = vocabulary or default_vocabulary()
    if not 0 <= end_id < 1 << 16:
        raise ValueError("the end id must fit 16 bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u2").tobytes()
        name = f"{path}/part-{TaskContext.get().partitionId():08d}.bin"
        docs = 0
        with committed(name) as out:
            for batch in batches:
                for value in batch.column(0):
                    whole = value.as_py()
                    if whole and any(s in whole for s in enc.special):
                        ids = enc.plain_without_specials(whole)
                    else:
                        ids = enc.encode(whole)
                    ids = np.frombuffer(ids, "<u4")
                    if ids.size and (ids.max() >= 1 << 16 or (ids == end_id).any()):
                        raise ValueError("a text has ids that flat 16-bit files cannot hold, or the end id")
                    out.write(ids.astype("<u2").tobytes() + end)
                    docs += 1
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": pa.array([docs], pa.int64())})

    pick(df, text=text).mapInArrow(write, "file string, n_docs long").write.parquet(f"{path}-written")


def scan_flat(spark: SparkSession, path: str, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document of the flat files below ``path``.

    Columns: file, doc_in_file (from 0), start (ids of the file before it), n_tokens
    (without the end id), terminated.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", (F.col("length") / 2).cast("long").alias("n_ids"))
    files = listed.where("n_ids > 0")
    blocks = files.select("path", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block_ids}"))).alias("block"))
    width = max(1, spark.sparkContext.defaultParallelism * 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * block_ids
                take = min(block_ids, row["n_ids"] - first)
                with opened(row["path"]) as f:
                    ids = np.frombuffer(f.read_at(2 * take, 2 * first), "<u2")
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [row["path"]],
                        "n_ids": pa.array([row["n_ids"]], pa.int64()),
                        "block": pa.array([row["block"]], pa.int64()),
                        "ends": pa.array([ends], pa.list_(pa.int64())),
                    }
                )

    found = blocks.repartition(width, "path", "block").mapInArrow(scan, "path string, n_ids long, block long, ends array<long>")
    # Written once: both kinds of documents below come from it, and no file is scanned twice.
    found = saved(found, "separators").select(
        "*",
        F.size("ends").cast("long").alias("n_ends"),
        F.try_element_at("ends", F.lit(-1)).alias("last_end"),
        F.floor(F.col("block") / CHUNK_BLOCKS).alias("chunk"),
    )
    # Two levels: within a chunk of blocks, and over the chunks of a file.
    before = Window.partitionBy("path", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = found.groupBy("path", "chunk").agg(F.sum("n_ends").alias("c_n"), F.max("last_end").alias("c_last"))
    ahead = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("path", "chunk", F.sum("c_n").over(ahead).alias("c_n"), F.max("c_last").over(ahead).alias("c_last"))
    stitched = found.select("*", F.sum("n_ends").over(before).alias("b_n"), F.max("last_end").over(before).alias("b_last")).join(chunks, ["path", "chunk"])
    zero = F.lit(0).cast("long")
    stitched = stitched.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "n_ids",
        "ends",
        (F.coalesce("b_n", zero) + F.coalesce("c_n", zero)).alias("docs_before"),
        (F.coalesce("b_last", "c_last", F.lit(-1).cast("long"))).alias("carried_end"),
    )
    closed = stitched.select("file", "docs_before", "carried_end", "ends", F.posexplode("ends").alias("k", "end"))
    closed = closed.select(
        "file",
        (F.col("docs_before") + F.col("k")).alias("doc_in_file"),
        F.when(F.col("k") == 0, F.col("carried_end") + 1).otherwise(F.get("ends", F.col("k") - 1) + 1).alias("start"),
        "end",
    ).select("file", "doc_in_file", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = stitched.groupBy("file", "n_ids").agg(
        F.max(F.col("docs_before") + F.size("ends")).alias("doc_in_file"),
        (F.max(F.greatest("carried_end", F.coalesce(F.array_max("ends"), F.lit(-1).cast("long")))) + 1).alias("start"),
    )
    tails = tails.where("start < n_ids").select("file", "doc_in_file", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(tails)

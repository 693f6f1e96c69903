"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: full pieces of
the longest length, then one for each set bit of the rest, longest first. Pieces of one
length form a bucket, a folder of its own when they are written; each is a sequence of its own, so no sequence crosses documents and
none needs padding. Nothing is shuffled: a sequence's number is made of its bucket, its
task and its rank there, so it is the same when a task is run again.

Defined results: a null or empty text has the end id alone, one piece of length 1; rows with
the same or a null document id are packed like any other; long texts are cut into as many
pieces as they need; an empty table has no pieces; other columns are left out, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick
from .tokens import CACHE_ENTRIES, default_vocabulary, encoder


def lengths_of(n: int, longest: int) -> list[int]:
    """The pieces' lengths, in the order in which they cover the document."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", longest: int = 1024, end_id: int = 0, vocabulary: str | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length (its bucket), doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    docs = pick(df, doc_id=doc_id, text=text)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, cache_entries)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        ranks = [0] * longest.bit_length()
        for batch in batches:
            keys = batch.column(0)
            at: list[int] = []
            columns: tuple[list, ...] = ([], [], [], [], [])
            size = 0

            def made() -> pa.RecordBatch:
                starts, lengths, totals, numbers, ids = columns
                longs = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, numbers)]
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at, pa.int64())), *longs, pa.array(np.zeros(len(at), np.int64)), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

            for k, value in enumerate(batch.column(1)):
                ids = enc.encode(value.as_py()) + end
                total = len(ids) // 4
                start = 0
                for length in lengths_of(total, longest):
                    level = length.bit_length() - 1
                    at.append(k)
                    for column, x in zip(columns, (start, length, total, (level << 58) | (task << 32) | ranks[level], ids[4 * start : 4 * (start + length)])):
                        column.append(x)
                    ranks[level] += 1
                    start += length
                size += total
                if size >= 1 << 20:
                    yield made()
                    at, columns, size = [], ([], [], [], [], []), 0
            if at:
                yield made()

    return docs.mapInArrow(cut, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def bucketed(pieces: DataFrame, path: str) -> DataFrame:
    """Write the pieces with one folder for each length, and read them back; a reader of one length opens its folder alone.

    Each task writes a file for each length it has; nothing is shuffled.
    """
    pieces.write.partitionBy("length").option("compression", "zstd").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path).select(*pieces.columns)

"""Token files of patched frame-of-reference blocks (PFOR).

A file holds the ids of documents in order, cut into blocks of BLOCK ids. Each block keeps
its minimum; the differences to it are packed at the width that a given share of them
needs, and the rest are exceptions: their places and high bits are listed after the packed
words. The file's end holds the start of every block, the documents' ids and lengths, so
any range of ids can be read by decoding its blocks alone.

Defined results: a null or empty text has the end id alone; rows of the same document id
are all kept, next to each other; null document ids come first; long texts span as many blocks
as they need; an empty table writes no files; other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, saved, with_prefix
from .files import committed, opened
from .tokens import default_vocabulary, encoder

MAGIC = b"PFORTOK1"
BLOCK = 4096
#: Share of a block's differences that must fit the packed width.
PACKED_SHARE = 0.99
#: Blocks that are encoded, or decoded, at once.
BATCH_BLOCKS = 256
_HEAD = struct.Struct("<IIHH")  # ids, minimum, width, exceptions
_TAIL = struct.Struct("<QQQQ8s")  # footer's place, blocks, bytes of the documents' table, ids, magic


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32 unsigned values to rows of ``width`` 32-bit words."""
    columns = np.ascontiguousarray(values.T)
    words = np.zeros((width, values.shape[0]), np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        words[word] |= columns[i] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= columns[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack_bits."""
    columns = np.ascontiguousarray(words.T)
    values = np.zeros((32, words.shape[0]), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        values[i] = columns[word] >> np.uint32(shift)
        if shift + width > 32:
            values[i] |= columns[word + 1] << np.uint32(32 - shift)
        values[i] &= mask
    return np.ascontiguousarray(values.T)


def encode_blocks(ids: np.ndarray, share: float = PACKED_SHARE) -> list[bytes]:
    """Encode ids (unsigned 32-bit) as blocks of BLOCK ids; the last may be shorter."""
    out: list[bytes] = []
    full = ids.size // BLOCK
    if full:
        out += _encode_rows(ids[: full * BLOCK].reshape(full, BLOCK), BLOCK, share)
    if ids.size > full * BLOCK:
        rest = ids[full * BLOCK :]
        row = np.full((1, -(-rest.size // 32) * 32), rest.min(), np.uint32)
        row[0, : rest.size] = rest
        out += _encode_rows(row, rest.size, share)
    return out


def _encode_rows(rows: np.ndarray, n: int, share: float) -> list[bytes]:
    lowest = rows.min(axis=1)
    gaps = rows - lowest[:, None]
    bits = np.frexp(gaps.astype(np.float64))[1].astype(np.uint8)
    need = min(rows.shape[1], max(1, int(np.ceil(share * rows.shape[1]))))
    widths = np.sort(bits, axis=1)[:, need - 1]
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = gaps[at]
        low = part & np.uint32((1 << width) - 1)
        packed = pack_bits(low.reshape(-1, 32), width).reshape(len(at), -1).astype("<u4")
        outside = bits[at] > width
        for k, block in enumerate(at.tolist()):
            places = np.flatnonzero(outside[k])
            high = (part[k, places].astype(np.uint64) >> np.uint64(width)).astype("<u4")
            head = _HEAD.pack(n, int(lowest[block]), width, places.size)
            blocks[block] = head + packed[k].tobytes() + places.astype("<u2").tobytes() + high.tobytes()
    return blocks


def tail(foot: int, blocks: int, table: int, n_ids: int) -> bytes:
    return _TAIL.pack(foot, blocks, table, n_ids, MAGIC)


def decode_block(data: bytes) -> np.ndarray:
    n, lowest, width, exceptions = _HEAD.unpack_from(data)
    groups = -(-n // 32)
    words = np.frombuffer(data, "<u4", groups * width, _HEAD.size).reshape(groups, width)
    gaps = unpack_bits(words, width).reshape(-1)
    if exceptions:
        at = _HEAD.size + 4 * groups * width
        places = np.frombuffer(data, "<u2", exceptions, at)
        high = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
        gaps[places] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return gaps[:n] + np.uint32(lowest)


class TokenFile:
    """Reads a token file by its index."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        foot, blocks, table, self.n_ids, magic = _TAIL.unpack(f.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or a cut one")
        footer = f.read_at(8 * blocks + table, foot)
        self.starts = np.append(np.frombuffer(footer, "<u8", blocks).astype(np.int64), foot)
        self.documents = pa.ipc.open_stream(footer[8 * blocks :]).read_all()

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of the blocks from ``first`` to before ``end``."""
        base = int(self.starts[first])
        data = self.f.read_at(int(self.starts[end]) - base, base)
        cuts = (self.starts[first : end + 1] - base).tolist()
        return np.concatenate([decode_block(data[a:b]) for a, b in zip(cuts, cuts[1:])])

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start``, from their blocks alone."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, end = start // BLOCK, -(-(start + count) // BLOCK)
        return self.blocks(first, end)[start - first * BLOCK :][:count]

    def each(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(document id, start, ids) of every document, reading forwards."""
        start, block, total = 0, 0, len(self.starts) - 1
        parts: list[np.ndarray] = []
        have = 0
        for doc_id, n in zip(self.documents["doc_id"], self.documents["n_tokens"].to_pylist()):
            while have < n and block < total:
                new = self.blocks(block, min(total, block + BATCH_BLOCKS))
                block = min(total, block + BATCH_BLOCKS)
                parts.append(new)
                have += new.size
            joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield doc_id.as_py(), start, joined[:n]
            parts, have, start = [joined[n:]], have - n, start + n


def write_tokens(df: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None, share: float = PACKED_SHARE) -> DataFrame:
    """Write token files below ``path``, documents in ascending order of id over the files.

    Texts cross one shuffle, by ranges of (id, hash of text) that keep many rows of one id
    apart; each partition writes one file. Returns the manifest: file_no, file, n_docs, n_ids.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = pick(df, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie").asc())
    # The id's Arrow type is taken from the batches, so ids of any type keep theirs.

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId()
        name = f"{path}/part-{number:08d}.pfor"
        keys: list[pa.Array] = []
        lengths: list[int] = []
        waiting: list[bytes] = []
        size = at = 0
        starts: list[int] = []
        total = 0

        def flush(out, last: bool) -> None:
            nonlocal waiting, size, at, total
            ids = np.frombuffer(b"".join(waiting), "<u4")
            cut = ids.size if last else ids.size // BLOCK * BLOCK
            for block in encode_blocks(ids[:cut], share):
                starts.append(at)
                out.write(block)
                at += len(block)
            total += cut
            waiting, size = [ids[cut:].tobytes()], ids.size - cut

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with committed(name) as out:
            out.write(MAGIC)
            at = len(MAGIC)
            batch: pa.RecordBatch | None = first
            while batch is not None:
                # A copy: a slice would keep the whole batch, texts included, for as long as the file is written.
                keys.append(batch.column(0).take(pa.array(range(batch.num_rows), pa.int64())))
                for value in batch.column(1):
                    ids = enc.encode(value.as_py()) + end
                    lengths.append(len(ids) // 4)
                    waiting.append(ids)
                    size += len(ids) // 4
                    if size >= BLOCK * BATCH_BLOCKS:
                        flush(out, False)
                batch = next(batches, None)
            flush(out, True)
            table = pa.table({"doc_id": pa.chunked_array(keys), "n_tokens": pa.array(lengths, pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            documents = sink.getvalue().to_pybytes()
            out.write(np.array(starts, "<u8").tobytes() + documents)
            out.write(tail(at, len(starts), len(documents), total))
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "file": [name], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return saved(ordered.mapInArrow(write, "file_no long, file string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Read token files back: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    files = with_prefix(manifest, "file_no", ["n_ids"]).select("file", "before_n_ids")
    tasks = max(1, min(100_000, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as f:
                    token_file = TokenFile(f)
                    kind = token_file.documents.schema.field("doc_id").type
                    rows: list[tuple] = []
                    size = 0

                    def made() -> pa.RecordBatch:
                        keys, starts, counts, ids = zip(*rows)
                        return pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, kind), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())})

                    for key, start, ids in token_file.each():
                        rows.append((key, row["before_n_ids"] + start, ids.size, ids.astype("<u4").tobytes()))
                        size += ids.size
                        if size >= 1 << 20:
                            yield made()
                            rows, size = [], 0
                    if rows:
                        yield made()

    return files.repartition(tasks).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids binary")

"""Katz backoff language model of order two.

P(w | h) = d(c(h w)) c(h w) / c(h) for pairs seen in training, else alpha(h) P(w);
P(w) = d(c(w)) c(w) / N for words seen, else the mass that the unigram discounts leave, as
one unknown word. d are Good-Turing discounts for counts up to K, as Katz gave them. alpha(h)
is what h's discounts leave, over what P leaves for words not seen after h, so every P(. | h)
adds up to one over the vocabulary and the unknown word. A context without any discounted
pair would leave nothing; its count is taken as one higher.

How it runs. Documents are cut into blocks of a few million tokens; a task writes a block
as a file of token numbers, with its words by hash, into the shared folder, and later passes
read blocks by name. Counting and lookup are one exchange: blocks send their distinct words,
and then their distinct pairs by context, to buckets, packed in one row for each block and
bucket; a bucket adds up the counts of all blocks and answers each block in the order of what
it sent. Contexts with more than a fair share of the tokens are dealt to several buckets by
the second word; only their sums (at most 4 for each bucket of BUCKET_TOKENS tokens) come
together at the driver. Tables: words and n-grams by bucket. An exchange has a row for each
block and bucket that have words in common, so both sizes should rise with a large corpus.

Defined results: a null or empty text has the end token alone; documents without an id are
learned from; rows with the same id are scored each; without training documents the unknown
word has probability one. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers
from .common import pick, scratch
from .files import committed, opened

#: Highest count that is discounted.
K = 5
BLOCK_TOKENS = 4_000_000
BUCKET_TOKENS = 2_000_000
MIN_BUCKETS = 32
#: Hashes of two strings that are never words: the end of a text, and its start.
END = int(np.uint64(xxhash.xxh3_64_intdigest(b"")).astype(np.int64))
START = int(np.uint64(xxhash.xxh3_64_intdigest(b" ")).astype(np.int64))


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def small(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all fit."""
    return x.astype(np.uint32 if not x.size or int(x.max()) < 1 << 32 else np.int64)


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d for counts 0 (unused) to K, from how many kinds have count 1 to K + 1.

    Katz's formula where it gives discounts between 0 and 1; where counts of counts are too
    few for it, absolute discounting by n1 / (n1 + 2 n2), between 0.1 and 0.9.
    """
    n = [0, *[int(x) for x in counts_of_counts]]
    d = np.ones(K + 1)
    share = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = n[r] and share < 1 and ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share)
        d[r] = good if good and 0 < good < 1 else 0
    if (d[1:] == 0).any():
        off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
        d[1:] = [(r - off) / r for r in range(1, K + 1)]
    return d


@dataclass
class Unigrams:
    tokens: int  # N
    kinds: int  # V
    texts: int  # training documents: the count of the start as a context
    d: np.ndarray
    total: int = 0  # N, or one more where no word is discounted
    unknown: float = 1.0

    @classmethod
    def of(cls, tokens: int, kinds: int, texts: int, counts_of_counts: list[int]) -> "Unigrams":
        d = discounts(counts_of_counts)
        lost = sum(r * n * (1 - d[r]) for r, n in enumerate(counts_of_counts[:K], 1))
        total = tokens if lost > 0 else tokens + 1
        return cls(tokens, kinds, texts, d, total, (lost if lost > 0 else 1.0) / total)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, K)] ** (c <= K) * c / self.total, self.unknown)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of one value in the first column: (value, the other columns)."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            value = int(columns[0][a])
            if value != key and parts:
                yield key, [np.concatenate(x) for x in zip(*parts)]
                parts = []
            key = value
            parts.append([c[a:b] for c in columns[1:]])
    if parts:
        yield key, [np.concatenate(x) for x in zip(*parts)]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, from, to) of its runs."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1)).tolist()
    return order, [(int(buckets[order[a]]), a, b) for a, b in zip(cuts, [*cuts[1:], order.size])]


def _write_blocks(docs: DataFrame, path: str, block_tokens: int, buckets: int) -> DataFrame:
    """Write (doc_id, text, held_out) as blocks; bucket, block, payload: each block's words and their training counts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("katz")
        task, number = TaskContext.get().partitionId(), 0
        keys, held, ends, tokens, words, size = [], [], [], [], _Numbers(), 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, ends, tokens, words, size, number
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words] + [xxhash.xxh3_64_intdigest(b" ")], np.uint64).view(np.int64)
            order = np.argsort(hashes)
            place = np.empty(order.size, np.uint32)
            place[order] = np.arange(order.size, dtype=np.uint32)
            local = place[np.concatenate(tokens)]
            ends_at, held_out = np.cumsum(ends), np.array(held, bool)
            trained = np.repeat(~held_out, ends)
            counts = np.bincount(local[trained], minlength=order.size)
            counts[place[-1]] = int((~held_out).sum())  # the start
            block = (task << 24) | number
            hashes = hashes[order]
            with committed(f"{path}/{block}.block") as out:
                out.write(packed(hashes, local, ends_at, held_out, np.array(pa.concat_arrays(keys).to_pylist(), object)))
            number += 1
            keys, held, ends, tokens, words, size = [], [], [], [], _Numbers(), 0
            sorted_by, runs = _by_bucket(_word_bucket(hashes, buckets))
            payloads = [packed(hashes[sorted_by[a:b]], counts[sorted_by[a:b]].astype(np.uint32)) for _, a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([block] * len(runs), pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "block", "payload"])

        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                found = text.encode("utf-8", "replace").lower().split() if text else []
                found.append(b"")
                tokens.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                keys.append(batch.column(0).slice(k, 1))
                held.append(batch.column(2)[k].as_py())
                ends.append(len(found))
                size += len(found)
                if size >= block_tokens:
                    yield flush()
        if size:
            yield flush()

    return docs.mapInArrow(write, "bucket int, block long, payload binary")


def _count_words(sent: DataFrame) -> DataFrame:
    """Add up each bucket's words. Rows by kind:

    answer: block, bucket, payload (ids and counts, in the order sent); words: the bucket's table;
    stat: what in block, value: tokens (0), words of count 1 to K + 1, all words (-1), texts (-2).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("katz")
        for bucket, (blocks, payloads) in _by_key(batches):
            parts = [unpacked(p) for p in payloads]
            words, group = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(group, np.concatenate([p[1] for p in parts]).astype(np.float64), words.size).astype(np.int64)
            ids = (bucket << 32) + np.arange(words.size, dtype=np.int64)
            rows: list[tuple] = []
            at = 0
            for block, (hashes, _) in zip(blocks.tolist(), parts):
                mine = group[at : at + hashes.size]
                rows.append(("answer", block, bucket, packed(ids[mine], total[mine]), None))
                at += hashes.size
            real = total[(words != START) & (total > 0)]
            stats = {0: real.sum(), -1: real.size, -2: total[words == START].sum()} | {r: (real == r).sum() for r in range(1, K + 2)}
            rows += [("stat", what, bucket, None, float(v)) for what, v in stats.items()]
            rows.append(("words", bucket, bucket, packed(words, total), None))
            yield _rows(rows)

    ordered = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    return ordered.mapInArrow(count, ROWS)


#: Rows of both exchanges' answers and tables.
ROWS = "kind string, block long, bucket int, payload binary, value double"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, block, bucket, payload, value = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.array(value, pa.float64())], ["kind", "block", "bucket", "payload", "value"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write exchange rows as a table by kind, and read it."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema("block long, bucket int, payload binary, value double, kind string").parquet(path)


def _answers(stored: DataFrame) -> DataFrame:
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of our own: payloads are small, their work is not
    return stored.where("kind = 'answer'").select("block", "bucket", "payload").repartition(tasks, "block").sortWithinPartitions("block", "bucket")


def _read(path: str, name: str) -> tuple[np.ndarray, ...]:
    with opened(f"{path}/{name}") as f:
        return unpacked(f.read())


def _pairs(local: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, word) of a block as single numbers, and each token's place among them."""
    before = np.empty_like(local)
    before[1:] = local[:-1]
    before[0] = start
    before[ends[:-1]] = start
    return np.unique((before.astype(np.int64) << 32) | local, return_inverse=True)


def _bucket(first: np.ndarray, second: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket by its context's hash, and by its word's where the context is spread."""
    mix = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    return ((mix(first) + mix(second) % spread.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class _Block:
    """A block's pairs in the order in which they are sent: by bucket, context and word."""

    hashes: np.ndarray
    local: np.ndarray
    ends: np.ndarray
    held: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    spread: np.ndarray  # buckets of each word as a context
    first: np.ndarray
    second: np.ndarray
    inverse: np.ndarray  # of each token, its pair
    order: np.ndarray
    runs: list[tuple[int, int, int]]

    @classmethod
    def of(cls, path: str, block: int, ids: np.ndarray, counts: np.ndarray, tokens: int, buckets: int) -> "_Block":
        hashes, local, ends, held, keys = _read(path, f"{block}.block")
        pairs, inverse = _pairs(local, ends, int(np.searchsorted(hashes, START)))
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        spread = np.maximum(1, np.minimum(buckets, -(-4 * buckets * counts // max(1, tokens))))
        at = _bucket(hashes[first], hashes[second], spread[first], buckets)
        order = np.lexsort((ids[second], ids[first], at))
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1)).tolist()
        runs = [(int(at[order[a]]), a, b) for a, b in zip(cuts, [*cuts[1:], order.size])]
        return cls(hashes, local, ends, held, keys, ids, counts, spread, first, second, inverse, order, runs)


def _looked_up(path: str, block: int, buckets_of_words: int, buckets: np.ndarray, payloads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a block's words, from the answers of its buckets."""
    hashes = _read(path, f"{block}.block")[0]
    order, runs = _by_bucket(_word_bucket(hashes, buckets_of_words))
    if [r[0] for r in runs] != buckets.tolist():
        raise ValueError(f"block {block} lacks answers")
    ids, counts = np.empty(hashes.size, np.int64), np.empty(hashes.size, np.int64)
    for (_, a, b), payload in zip(runs, payloads):
        ids[order[a:b]], counts[order[a:b]] = unpacked(payload)
    return ids, counts


def _send(answers: DataFrame, path: str, uni: Unigrams, word_buckets: int, buckets: int) -> DataFrame:
    """From the words' answers by block: bucket, block, payload with the block's pairs there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("katz")
        for block, (answered, payloads) in _by_key(batches):
            ids, counts = _looked_up(path, block, word_buckets, answered, payloads)
            with committed(f"{path}/{block}.words") as out:  # scoring needs them again
                out.write(packed(ids, counts))
            x = _Block.of(path, block, ids, counts, uni.tokens, buckets)
            trained = np.bincount(x.inverse[np.repeat(~x.held, np.diff(x.ends, prepend=0))], minlength=x.first.size)
            for bucket, a, b in x.runs:
                some = x.order[a:b]
                contexts, words = ids[x.first[some]], ids[x.second[some]]
                heads = np.flatnonzero(np.diff(contexts, prepend=-1))
                steps = np.diff(words, prepend=0)
                steps[heads] = words[heads]
                payload = packed(contexts[heads], np.diff(np.append(heads, some.size)).astype(np.uint32), steps, trained[some].astype(np.uint32), small(counts[x.second[some]]), x.spread[x.first[some][heads]] > 1)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "block", "payload"])

    return answers.mapInArrow(send, "bucket int, block long, payload binary")


def _count(sent: DataFrame, uni: Unigrams) -> DataFrame:
    """Add up each bucket's pairs. Rows by kind:

    answer: block, bucket, payload (counts of the block's pairs, sums of its contexts);
    sum: context id in block, place of the sum in bucket, value (spread contexts);
    kinds: count in block, how many pairs have it in value; pairs: the bucket's table.
    """

    def reduce(bucket: int, blocks: np.ndarray, payloads: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(p) for p in payloads]
        first, second, sizes = [], [], []
        for heads, runs, steps, *_ in parts:
            first.append(np.repeat(heads, runs))
            total = np.cumsum(steps)
            begins = np.concatenate(([0], np.cumsum(runs)[:-1])).astype(np.int64)
            second.append(total - np.repeat(total[begins] - steps[begins], runs))
            sizes.append(steps.size)
        x, y = np.concatenate(first), np.concatenate(second)
        order = np.lexsort((y, x))
        new = np.ones(order.size, bool)
        new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
        places = np.flatnonzero(new)
        group = np.empty(order.size, np.int64)
        group[order] = np.cumsum(new) - 1
        count = np.add.reduceat(np.concatenate([p[3] for p in parts]).astype(np.int64)[order], places)
        contexts, words = x[order][places], y[order][places]
        of_word = np.concatenate([p[4] for p in parts])[order][places]
        seen = count > 0
        heads = np.flatnonzero(np.diff(contexts, prepend=-1))
        sums = np.stack([np.add.reduceat(v, heads) for v in [*[(count == r) * 1.0 for r in range(1, K + 1)], np.where(count > K, count, 0) * 1.0, np.where(seen, uni.probability(of_word), 0.0)]])
        ids = contexts[heads]

        def row(kind: str, block: int, place: int, payload: bytes | None = None, value: float | None = None) -> tuple:
            return kind, block, place, payload, value

        rows = []
        at = 0
        spread_ids: set[int] = set()
        for block, part, n in zip(blocks.tolist(), parts, sizes):
            mine = np.searchsorted(ids, part[0])
            rows.append(row("answer", block, bucket, packed(small(count[group[at : at + n]]), sums[:, mine])))
            spread_ids.update(part[0][part[5]].tolist())
            at += n
        for context in sorted(spread_ids):
            column = sums[:, np.searchsorted(ids, context)]
            rows += [row("sum", context, j, None, float(v)) for j, v in enumerate(column)]
        rows += [row("kinds", r, bucket, None, float((count == r).sum())) for r in range(1, K + 2)]
        gaps = np.diff(words, prepend=0)
        gaps[heads] = words[heads]
        rows.append(row("pairs", bucket, bucket, packed(ids, np.diff(np.append(heads, contexts.size)).astype(np.uint32), gaps, small(count))))
        yield _rows(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("katz")
        for bucket, (blocks, payloads) in _by_key(batches):
            yield from reduce(bucket, blocks, payloads)

    ordered = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    return ordered.mapInArrow(count, ROWS)


def _scored(answers: DataFrame, path: str, uni: Unigrams, d: np.ndarray, spread_sums: dict[int, np.ndarray], buckets: int) -> DataFrame:
    def total(sums: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts: the count to divide by, and alpha."""
        kept = sums[K] + (d[1:, None] * np.arange(1, K + 1)[:, None] * sums[:K]).sum(axis=0)
        lost = ((1 - d[1:])[:, None] * np.arange(1, K + 1)[:, None] * sums[:K]).sum(axis=0)
        whole = np.where(lost > 0, c, c + 1).astype(np.float64)
        rest = np.maximum(1 - sums[K + 1], np.finfo(float).tiny)
        # A context never seen backs off with weight one.
        return whole, np.where(c > 0, (whole - kept) / np.where(whole > 0, whole, 1) / rest, 1.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("katz")
        for block, (answered, payloads) in _by_key(batches):
            ids, counts = _read(path, f"{block}.words")
            x = _Block.of(path, block, ids, counts, uni.tokens, buckets)
            local, ends, held, keys, first, second, inverse = x.local, x.ends, x.held, x.keys, x.first, x.second, x.inverse
            if [r[0] for r in x.runs] != answered.tolist():
                raise ValueError(f"block {block} lacks answers")
            pair_count = np.empty(first.size, np.int64)
            sums = np.zeros((K + 2, ids.size))
            for (_, a, b), payload in zip(x.runs, payloads):
                mine = x.order[a:b]
                got, context_sums = unpacked(payload)
                pair_count[mine] = got
                owners = first[mine]
                sums[:, owners[np.flatnonzero(np.diff(ids[owners], prepend=-1))]] = context_sums
            for k in np.flatnonzero(x.spread > 1).tolist():
                if int(ids[k]) in spread_sums:
                    sums[:, k] = spread_sums[int(ids[k])]
            whole, alpha = total(sums, counts)
            backed = uni.probability(counts)
            seen = d[np.minimum(pair_count, K)] ** (pair_count <= K) * pair_count / np.where(whole[first] > 0, whole[first], 1)
            logs = np.log10(np.where(pair_count > 0, seen, alpha[first] * backed[second]))
            base = np.log10((counts + 1) / (uni.tokens + uni.kinds + 1))
            begins = np.concatenate(([0], ends[:-1]))
            each = lambda v: np.add.reduceat(v, begins)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.tolist(), pa.int64()),
                    pa.array(held),
                    pa.array(np.diff(ends, prepend=0)),
                    pa.array(each((counts[local] > 0).astype(np.int64))),
                    pa.array(np.full(ends.size, uni.tokens, np.int64)),
                    pa.array(each(base[local])),
                    pa.array(each(logs[inverse])),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).cast(target)

    target = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return answers.mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: str = "held_out", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, path: str | None = None) -> DataFrame:
    """Learn from the rows that are not held out, and score all rows."""
    spark = df.sparkSession
    path = path or scratch(spark, "katz")
    docs = pick(df, doc_id=doc_id, text=text, held_out=held_out).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    word_buckets = max(MIN_BUCKETS, docs.rdd.getNumPartitions())
    words = _stored(_count_words(_write_blocks(docs, path, block_tokens, word_buckets)), "words")
    stats = {r["block"]: int(r["v"]) for r in words.where("kind = 'stat'").groupBy("block").agg(F.sum("value").alias("v")).collect()}
    uni = Unigrams.of(stats.get(0, 0), stats.get(-1, 0), stats.get(-2, 0), [stats.get(r, 0) for r in range(1, K + 2)])

    buckets = max(MIN_BUCKETS, -(-uni.tokens // bucket_tokens))
    ngrams = _stored(_count(_send(_answers(words), path, uni, word_buckets, buckets), uni), "ngrams")
    kinds = {r["block"]: int(r["n"]) for r in ngrams.where("kind = 'kinds'").groupBy("block").agg(F.sum("value").alias("n")).collect()}
    d = discounts([kinds.get(r, 0) for r in range(1, K + 2)])
    spread_sums: dict[int, np.ndarray] = {}
    for r in ngrams.where("kind = 'sum'").groupBy("block", "bucket").agg(F.sum("value").alias("v")).toLocalIterator():
        spread_sums.setdefault(r["block"], np.zeros(K + 2))[r["bucket"]] = r["v"]
    return _scored(_answers(ngrams), path, uni, d, spread_sums, buckets)


def bits(scores: DataFrame) -> float:
    """Mean negative log2 probability of a token."""
    total = scores.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return -total["s"] / total["n"] * math.log2(10)

"""N-gram Jaccard self-join by PartEnum signatures.

Sets of equal size band (a level) that are similar enough differ in few shingles: at most
k = (1 - s) / (1 + s) * 2 * r for sizes up to r. The shingle domain is partitioned by hash.
With k + 1 + slack partitions at most k can differ, so similar sets agree on some whole
partition; small sets use few partitions and enumerate the subsets that leave out k of
them. A signature is the hash of a set's shingles in such a subset of partitions: similar
sets share at least one. A set gives signatures for its own level and for those above
that its partners may be in.

An empty subset is no signature. A set with more empty partitions than the slack might only
share those with a partner; the partner then has as many, so both add signatures under the
next seed, and so on; after the last seed the empty ones are signatures too.

Signature groups are not expanded into pairs: each member is checked against the group's
first; what links is merged into components; only groups that still span several components
are searched within, by bit sketches that bound the distance from below, and the pairs
that pass are checked exactly. So no link between components is missed.

Defined results: null and wordless texts have empty sets and are linked with nothing; rows
with the same id count as one document; a row without an id has no component and no links;
equal texts are one node, represented by the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers
from .common import pick, saved
from .components import components
from .shingles import mixed, shingle_sets

#: Seeds that a set may go through before its empty subsets count.
SEEDS = 10
#: Ids up to which a list is sent to every task (about 40 bytes each in a hash relation: 40 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Tasks that look up one group of copies.
SALTS = 16
#: Members of one group that are checked by one task.
MEMBERS_A_TASK = 128
#: Rows of a signature group that are compared with each other in one task; larger groups are cut into blocks, and each pair of blocks is a task's.
BLOCK_ROWS = 2048
#: 64-bit words of the coarse sketch: parities of the shingles by hash.
SKETCH_WORDS = 8


@dataclass(frozen=True)
class Level:
    number: int
    low: int
    high: int
    differ: int  # k: shingles that a similar pair of the level may differ in
    parts: int
    left_out: int  # 0: each partition alone; else subsets without so many partitions
    slack: int

    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.parts), self.parts - self.left_out)) if self.left_out else [(i,) for i in range(self.parts)]


def level_of(number: int, low: int, high: int, percent: int) -> Level:
    s = Fraction(percent, 100)
    k = int((1 - s) / (1 + s) * 2 * high)
    if k == 0:
        return Level(number, low, high, 0, 1, 0, 0)
    if k <= 3:
        return Level(number, low, high, k, k + 3, k, 0)
    least = int(low * s)
    for slack in range(k + 2):
        parts = k + 1 + slack
        empty = parts * (1 - 1 / parts) ** least
        if slack >= empty + 0.8 * empty**0.5:
            return Level(number, low, high, k, parts, 0, slack)
    return Level(number, low, high, k, k + 2, 0, 1)


@lru_cache(maxsize=8)
def _ladder(percent: int, top: int) -> list[Level]:
    levels: list[Level] = []
    low = 1
    while not levels or levels[-1].high < top:
        high = low * 100 // percent
        levels.append(level_of(len(levels), low, high, percent))
        low = high + 1
    return levels


def levels_for(n: int, percent: int) -> list[Level]:
    """The levels in which a set of n shingles may have partners as large or larger, its own first."""
    top = n * 100 // percent
    bound = 64
    while bound < top:
        bound *= 2
    return [level for level in _ladder(percent, bound) if level.high >= n and level.low <= top]


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a set of shingle hashes."""
    out: list[np.ndarray] = []
    content = mixed(shingles + np.uint64(0x632BE59BD9B4E019))
    for level in levels_for(shingles.size, percent):
        for seed in range(SEEDS):
            number = level.number * SEEDS + seed + 1
            salt, turn = np.uint64(number), np.uint64(number * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
            if level.parts == 1:
                sums, full = content.sum(dtype=np.uint64)[None], np.array([True])
            else:
                at = ((mixed(shingles ^ turn) >> np.uint64(32)) % np.uint64(level.parts)).astype(np.uint16 if level.parts < 65536 else np.uint32)
                order = np.argsort(at, kind="stable")
                counts = np.bincount(at, minlength=level.parts)
                full = counts > 0
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
                sums = np.zeros(level.parts, np.uint64)
                sums[full] = np.add.reduceat(content[order], starts)
                if level.left_out:
                    chosen = level.subsets()
                    sums, full = np.array([sums[list(c)].sum(dtype=np.uint64) for c in chosen], np.uint64), np.array([full[list(c)].any() for c in chosen])
            last = seed == SEEDS - 1
            places = np.arange(sums.size) if last else np.flatnonzero(full)
            out.append(mixed(mixed(sums[places] + places.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) + salt))
            if sums.size - int(full.sum()) <= level.slack:
                break
    return np.concatenate(out)


def parities(shingles: np.ndarray, words: int) -> np.ndarray:
    """Parities of the set's shingles in 64 * words classes: differing bits never exceed differing shingles."""
    odd = np.bincount((shingles % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fine_words(n: int) -> int:
    """Words of the fine sketch: a power of two with about two bits or more for each shingle."""
    return max(SKETCH_WORDS, 1 << max(0, (2 * n - 1) // 64).bit_length())


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch in fewer classes."""
    while bits.size > words:
        half = bits.size // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, and 128 bits that identify the set."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        for batch in batches:
            sets = list(shingle_sets(text.as_py() for text in batch.column(1)))
            once = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            twice = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(once.view(np.int64)), pa.array(twice.view(np.int64))],
                ["doc_id", "n", "f1", "f2"],
            )

    return docs.mapInArrow(digest, "doc_id long, n long, f1 long, f2 long")


def _signed(docs: DataFrame, percent: int) -> DataFrame:
    """sig, doc_id: every signature of every set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            size = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "doc_id"])

            for doc_id, shingles in zip(ids, shingle_sets(text.as_py() for text in batch.column(1))):
                if shingles.size:
                    sigs = signatures(shingles, percent)
                    found.append(sigs)
                    owners.append(np.full(sigs.size, doc_id, np.int64))
                    size += sigs.size
                if size > 1 << 18:
                    yield made()
                    found, owners, size = [], [], 0
            if found:
                yield made()

    return docs.mapInArrow(sign, "sig long, doc_id long")


def _groups(signed: DataFrame) -> DataFrame:
    """sig, leader, doc_id: members of signature groups but their first, which is the leader."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        last_sig = last_leader = None
        for batch in batches:
            sigs, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not sigs.size:
                continue
            fresh = np.ones(sigs.size, bool)
            fresh[1:] = sigs[1:] != sigs[:-1]
            leaders = ids[np.maximum.accumulate(np.where(fresh, np.arange(sigs.size), 0))]
            if last_sig is not None and sigs[0] == last_sig:
                run = int(np.flatnonzero(fresh[1:])[0]) + 1 if fresh[1:].any() else sigs.size
                leaders = leaders.copy()
                leaders[:run] = last_leader
            last_sig, last_leader = sigs[-1], leaders[-1]
            more = np.flatnonzero(leaders != ids)
            if more.size:
                yield pa.RecordBatch.from_arrays([pa.array(sigs[more]), pa.array(leaders[more]), pa.array(ids[more])], ["sig", "leader", "doc_id"])

    ordered = signed.repartition("sig").sortWithinPartitions("sig", "doc_id")
    return ordered.mapInArrow(lead, "sig long, leader long, doc_id long")


def _sets(docs: DataFrame, sketched: bool) -> DataFrame:
    """doc_id, n, and the set's shingles (64-bit hashes), or its coarse and fine sketches."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        for batch in batches:
            rows, size = [], 0

            def made() -> pa.RecordBatch:
                ids, sizes, coarse, bodies = zip(*rows)
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(coarse, pa.list_(pa.int64())), pa.array(bodies, pa.binary())], ["doc_id", "n", "coarse", "body"])

            for doc_id, shingles in zip(batch.column(0).to_pylist(), shingle_sets(text.as_py() for text in batch.column(1))):
                coarse = parities(shingles, SKETCH_WORDS).view(np.int64) if sketched else None
                body = parities(shingles, fine_words(shingles.size)) if sketched else shingles
                rows.append((doc_id, shingles.size, coarse, body.tobytes()))
                size += shingles.size
                if size > 1 << 20:
                    yield made()
                    rows, size = [], 0
            if rows:
                yield made()

    return docs.mapInArrow(build, "doc_id long, n long, coarse array<long>, body binary")


def only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or is not (left_anti) among ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and fine sketches don't rule out: no similar pair is left out, and sets need not travel for the rest."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("body").alias(f"body_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(x.size, y.size)
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep.append((100 + percent) * differ <= (100 - percent) * n)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "body_a", "body_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(near, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sets are similar enough, by exact intersection.

    Members travel to their leader's task; a leader with many members is copied to several.
    """
    ids = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    bodies = saved(_sets(only(docs, ids, "left_semi"), False).select("doc_id", "body"), "sets")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).cast("int").alias("tasks"))
    salted = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"))
    members = salted.join(bodies, salted.b == bodies.doc_id).select("a", "salt", "b", "body")
    heads = tasks.join(bodies, tasks.a == bodies.doc_id).select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "body")
    together = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        key, heads = None, []
        for batch in batches:
            found_a, found_b = [], []
            for a, salt, b, data in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                shingles = np.frombuffer(data, np.uint64)
                if (a, salt) != key:
                    key, heads = (a, salt), []
                if b is None:  # one for each text of the leader's id
                    heads.append(shingles)
                    continue
                for head in heads:
                    common = np.intersect1d(head, shingles, assume_unique=True).size
                    if 100 * common >= percent * (head.size + shingles.size - common):
                        found_a.append(a)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return together.mapInArrow(check, "a long, b long").distinct()


def _across(groups: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of different components within one signature group that a sketch can't rule out."""
    named = labels.select(F.col("node").alias("doc_id"), "label")
    member = groups.join(named, "doc_id", "left").select("sig", "leader", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    first = named.select(F.col("doc_id").alias("leader"), F.col("label").alias("first"))
    member = member.join(first, "leader", "left").select("sig", "leader", "doc_id", "label", F.coalesce("first", "leader").alias("first"))
    mixed_sigs = member.where("label <> first").select("sig").distinct()
    member = member.join(mixed_sigs, "sig")
    rows = saved(member.select("sig", "doc_id", "label").unionByName(member.select("sig", F.col("leader").alias("doc_id"), F.col("first").alias("label"))).distinct(), "apart")
    # A large group is cut into blocks; every pair of blocks, a block with itself among them, is one piece of work.
    blocks = rows.groupBy("sig").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = rows.join(blocks, "sig").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = placed.join(sketches.select("doc_id", "n", "coarse"), "doc_id")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("sig", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "label", "doc_id", "n", "coarse")
    s = Fraction(percent, 100)
    share = float((1 - s) / (1 + s))

    def pairs_of(key: tuple | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        p, q = key[1:] if key else (0, 0)
        labels = np.array([r[1] for r in rows])
        if labels.size < 2 or (labels == labels[0]).all():
            return
        sides, ids, sizes = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
        bits = np.array([r[4] for r in rows], np.int64)
        for at in range(0, len(rows), 256):
            block = slice(at, at + 256)
            least = np.bitwise_count(bits[block, None, :] ^ bits[None, at:, :]).sum(axis=2, dtype=np.int64)
            most = share * (sizes[block, None] + sizes[None, at:]) + 1e-6
            close = (least <= most) & (labels[block, None] != labels[None, at:])
            if p != q:  # two blocks: each is compared with itself elsewhere
                close &= sides[block, None] != sides[None, at:]
            i, j = np.nonzero(close)
            i, j = i + at, j + at
            keep = i < j
            a, b = np.minimum(ids[i[keep]], ids[j[keep]]), np.maximum(ids[i[keep]], ids[j[keep]])
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.turn_to("jaccard")
        key, rows = None, []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                if row[:3] != key:
                    yield from pairs_of(key, rows)
                    key, rows = row[:3], []
                rows.append(row[3:])
        yield from pairs_of(key, rows)

    return met.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "doc_id").mapInArrow(search, "a long, b long").distinct()


def link(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = saved(_digest(docs), "digest")
    known = digest.where("n > 0 and doc_id is not null")
    # Only groups of copies are looked up, each from several tasks: one may hold a third of all rows.
    first = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = first.select("f1", "f2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(first, ["f1", "f2", "salt"], "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    same = saved(found.distinct(), "copies")
    copies = same.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("first")).alias("is_first")).where("not is_first").select("doc_id")
    nodes = only(docs.where("doc_id is not null"), copies, "left_anti")

    groups = saved(_groups(_signed(nodes, percent)), "groups")
    stars = saved(groups.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    wanted = saved(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    sketches = saved(_sets(only(nodes, wanted, "left_semi"), True), "sketches")

    # First each member with its smallest plausible leader, then with leaders of other components.
    stars_left = saved(_plausible(stars, sketches, percent), "near")
    nearest = saved(stars_left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    edges = saved(_verified(nearest, nodes, percent), "links")
    labels = components(edges)
    for more in ("stars", "groups"):
        if more == "stars":
            rest = _apart(stars_left.join(nearest, ["a", "b"], "left_anti"), labels)
        else:
            rest = _plausible(_across(groups, labels, sketches, percent, block_rows).join(stars, ["a", "b"], "left_anti"), sketches, percent)
        rest = saved(rest, "rest")
        if not rest.isEmpty():
            edges = saved(edges.unionByName(saved(_verified(rest, nodes, percent), "links")), "links")
            labels = components(edges)

    # A document's texts, its copies and its links all lead to one component.
    labels = labels.select(F.col("node").alias("first"), "label")
    reached = same.join(labels, "first", "left").select("doc_id", F.coalesce("label", "first").alias("label"))
    twice = reached.groupBy("doc_id").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    bridges = twice.where("least <> most").select("doc_id")
    if not bridges.isEmpty():  # ids with several texts join what those reach
        joined = reached.join(bridges, "doc_id").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
        merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("lower"))
        twice = twice.join(merged, twice.least == merged.label, "left").select("doc_id", F.coalesce("lower", "least").alias("least"))
    placed = twice.select(F.col("doc_id").alias("id"), F.col("least").alias("reached"))
    out = digest.join(placed, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("reached", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")

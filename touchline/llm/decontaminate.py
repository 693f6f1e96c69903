"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Each document's words are streamed
through it, keeping the longest match that ends at each word; a match of at least
``window`` words, or of a whole shorter item, marks the words it covers.

Memory: items are grouped into automata of at most ``MAX_ITEM_WORDS`` words; each group is a
pass of its own over the texts, so the items collected and sent to the tasks at once are bounded
whatever the number of items. Only spans are kept between passes.

Defined results: null or wordless texts have no words and no hits; wordless items match
nothing; items with the same id count once; items without an id mark words but have no
name in the lists. Repeated rows are each judged alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workers
from .common import pick, saved

#: Words of items that one automaton may hold.
MAX_ITEM_WORDS = 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAKS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().translate(_BREAKS).split() if text else []


class Automaton:
    """Generalised suffix automaton over the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        whole: dict[int, set[int]] = {}
        self.shortest = window
        for number, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not words:
                continue
            last = 0
            for w in words:
                last = self._add(last, w)
                if len(words) >= window:
                    ends.setdefault(last, set()).add(number)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                whole.setdefault(last, set()).add(number)
        self._finish(ends, whole)

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the longest run through p and word, cut out of q if q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def _finish(self, ends: dict[int, set[int]], whole: dict[int, set[int]]) -> None:
        """Items by state: whose windows end there; whose whole shorter text ends there."""
        order = sorted(range(1, len(self.link)), key=lambda s: self.length[s])
        below: dict[int, set[int]] = {s: set(x) for s, x in ends.items()}
        self.windows: dict[int, set[int]] = {}
        for s in reversed(order):
            if (found := below.pop(s, None)) is not None:
                if self.length[s] >= self.window:
                    if self.length[self.link[s]] < self.window:
                        self.windows[s] = found
                    below.setdefault(self.link[s], set()).update(found)
        # entry[s]: the ancestor whose runs of window words are the suffixes of s.
        self.entry = [0] * len(self.link)
        self.short: list[tuple[int, frozenset[int]] | None] = [None] * len(self.link)
        for s in order:
            up = self.link[s]
            self.entry[s] = self.entry[up] if up >= 0 and self.length[up] >= self.window else s
            above = self.short[up] if up >= 0 else None
            if s in whole:
                self.short[s] = (self.length[s], frozenset(whole[s]) | (above[1] if above else frozenset()))
            else:
                self.short[s] = above

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans [first, end) of covered words, disjoint and in order; numbers of the items matched."""
        known = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        items: set[int] = set()
        i, n = 0, len(known)
        while i < n:
            if known[i] is None:
                i += 1
                continue
            end = i
            while end < n and known[end] is not None:
                end += 1
            if end - i >= self.shortest:
                self._stream(known, i, end, spans, items)
            i = end
        return spans, items

    def _stream(self, known: list, first: int, end: int, spans: list[list[int]], items: set[int]) -> None:
        follow, link, length = self.next, self.link, self.length
        state = run = 0
        for i in range(first, end):
            w = known[i]
            while state and w not in follow[state]:
                state = link[state]
                run = length[state]
            if w in follow[state]:
                state = follow[state][w]
                run += 1
            cover = 0
            if run >= self.window:
                cover = run
                items |= self.windows[self.entry[state]]
            short = self.short[state]
            if short and short[0] > run:  # only a proper suffix of the state has been read
                short = self.short[link[state]]
            if short:
                cover = max(cover, short[0])
                items |= short[1]
            if cover:
                start = i + 1 - cover
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])


_automata: dict[tuple, Automaton] = {}
workers.on_change(_automata.clear)


def _automaton(key: str, items: list, window: int) -> Automaton:
    """The worker's automaton of a group of items; an earlier one is let go."""
    workers.turn_to("decontaminate")
    if (key, window) not in _automata:
        _automata.clear()
        _automata[key, window] = Automaton(items, window)
    return _automata[key, window]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and what stands between them."""
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in _WORD.finditer(data.lower())]
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at : places[first][0]])
        at = places[end - 1][1]
    return (b"".join(kept) + data[at:]).decode("utf-8", "replace")


def too_much(hit: int, words: int) -> bool:
    """The contract's rule of contamination: a twentieth of the words or more are hit."""
    return hit > 0 and 20 * hit >= words


def _item_groups(benchmark: DataFrame, item_id: str, item_text: str, max_item_words: int) -> Iterator[tuple[int, list[tuple[str | None, str | None]]]]:
    """How many groups there are, and the items of each; every group is of a bounded size, and there is at least one."""
    items = pick(benchmark, name=item_id, text=item_text).select(F.col("name").cast("string").alias("name"), "text")
    sized = items.withColumn("words", F.length("text") / 2 + 1)
    groups = max(1, -(-int(sized.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]) // max_item_words))
    for group in range(groups):
        yield groups, [(r["name"], r["text"]) for r in items.where(F.pmod(F.xxhash64("name", "text"), F.lit(groups)) == group).toLocalIterator()]


def _matches(spark: SparkSession, items: list, window: int):
    """A function from a text to its number of words, spans and item ids, for use in tasks."""
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def match(text: str | None) -> tuple[int, list[list[int]], list[str]]:
        automaton = _automaton(key, sent.value, window)
        words = words_of(text)
        spans, numbers = automaton.match(words)
        return len(words), spans, sorted({automaton.names[k] for k in numbers if automaton.names[k] is not None})

    return match


_SPANS, _ITEMS = "array<struct<first:int,end:int>>", "array<string>"


def _hit_rows(rows: DataFrame, match) -> DataFrame:
    """(row, text) to row, hit_spans, hit_items, hit_words."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [match(value.as_py()) for value in batch.column(1)]
            spans = pa.array([[{"first": a, "end": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[0] for x in found], pa.int32())], ["row", "hit_spans", "hit_items", "hit_words"])
        workers.give_back()

    return rows.mapInArrow(judge, f"row long, hit_spans {_SPANS}, hit_items {_ITEMS}, hit_words int")


def _passes(docs: DataFrame, at: int, groups: Iterator, first: tuple, window: int) -> DataFrame:
    """``docs`` with hit_*, over several groups of items: the texts are read once for each group, and only
    rows with hits are kept between the passes; the documents themselves are written once, with row numbers."""
    spark = docs.sparkSession
    names = [f"in_{i}" for i in range(len(docs.columns))]
    numbered = saved(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    texts = numbered.select("row", names[at])
    parts = []
    for k, (_, items) in enumerate(chain([first], groups)):
        hits = _hit_rows(texts, _matches(spark, items, window))
        # The first pass also counts the words of every row.
        parts.append(saved(hits if k == 0 else hits.where(F.size("hit_spans") > 0), "decontaminate-hits"))
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("row").agg(
        F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"), F.max("hit_words").alias("hit_words")
    )
    joined = numbered.join(merged, "row").select(*names, _joined_spans(F.col("hit_spans")).alias("hit_spans"), "hit_items", "hit_words")
    return joined.toDF(*docs.columns, "hit_spans", "hit_items", "hit_words")


def _joined_spans(spans: Column) -> Column:
    """Spans of several passes in order, those that overlap or touch made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        rest = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(s["first"] <= last["end"], F.lit(False)), F.concat(rest, F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with hit_words, hit_spans (of covered words) and hit_items (ids as strings) in last columns.

    The other columns pass through by position. A single group of items, the usual case, is
    one pass without a shuffle; further groups read the texts again.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    groups = _item_groups(benchmark, item_id, item_text, max_item_words)
    first = next(groups)
    if first[0] > 1:
        return _passes(docs, at, groups, first, window)
    match = _matches(spark, first[1], window)
    schema = docs.select("*", F.lit(None).cast(_SPANS).alias("hit_spans"), F.lit(None).cast(_ITEMS).alias("hit_items"), F.lit(0).cast("int").alias("hit_words")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [match(value.as_py()) for value in batch.column(at)]
            spans = pa.array([[{"first": a, "end": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
            arrays = [*batch.columns, spans, pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[0] for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "hit_spans", "hit_items", "hit_words"])

    return docs.mapInArrow(judge, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_item_words: int = MAX_ITEM_WORDS, changed: str = "hit_changed") -> DataFrame:
    """``docs`` without contaminated rows and, in the others, without the passages hit.

    ``changed`` is a last column that says whether the text was cut. The texts meet Python
    once; a row's spans are used where they are found.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    groups = _item_groups(benchmark, item_id, item_text, max_item_words)
    first = next(groups)
    hits, match = docs, None
    if first[0] > 1:
        hits = _passes(docs, at, groups, first, window)
    else:
        match = _matches(spark, first[1], window)
    schema = docs.select("*", F.lit(False).alias(changed)).schema
    width = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[int] = []
            new: dict[int, str] = {}
            known = zip(batch.column(width).to_pylist(), batch.column(width + 2).to_pylist()) if match is None else None
            for k in range(batch.num_rows):
                if match is None:
                    spans, words = next(known)
                    spans = [(s["first"], s["end"]) for s in spans]
                    value = batch.column(at)[k].as_py() if spans else None
                else:
                    value = batch.column(at)[k].as_py()
                    words, spans, _ = match(value)
                if too_much(sum(b - a for a, b in spans), words):
                    continue
                if spans:
                    new[k] = without_spans(value, spans)
                keep.append(k)
            columns = list(batch.columns[:width])
            if new:
                columns[at] = pa.array([new.get(k, value) for k, value in enumerate(columns[at].to_pylist())], columns[at].type)
            taken = pa.array(keep, pa.int64())
            flags = pa.array([k in new for k in keep], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in columns], flags], [*batch.schema.names[:width], changed])
        workers.give_back()

    return hits.mapInArrow(cut, schema)


def hit_count() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])

"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document's failures are a mask of bits. For each part and label, signed parity sums are
aggregated, one for each subset of the filters: the sum of (-1)^(failures inside the subset).
They are the Walsh-Hadamard transform of the counts by mask, so they add up over tasks, and
the inverse transform gives the exact counts. All orders, steps and Shapley values then come
from these few cells, whatever the number of documents: over all k! orders, a failing filter is
the first of a document's t failing ones in k! / t of them.

The filters: A few words, B few distinct words, C many capitals, D special characters, E a
text that a smaller id has as well. E is found from counts by (text's hash, part, labels): a
text that a third of all rows share is summed before it is shuffled, and no row is joined back.

Defined results: a null text is an empty one; a null language is the part ''; a null id is
neither smaller nor larger than another one, so such rows never fail E and make none fail; rows
of one id don't make each other fail E; a document without a label is neither good nor toxic,
and one with several rows of labels is good (or toxic) if any row says so. Long texts are read
whole. An empty table gives no rows. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, saved

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SPECIAL = "[#$%&*|]"
c = F.col


def of_text(text: str) -> list[Column]:
    """Whether filters A to D fail a text; ``words`` holds its words."""
    return [
        F.size("words") < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITAL_PERCENT * F.length(text),
        c(text).rlike(SPECIAL),
    ]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents by their failures. docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = reduce(lambda a, b: a + b, [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(of_text("text"))])
    rows = rows.select("doc_id", "part", bits.alias("bits"), *[F.xxhash64(F.lit(k), "text").alias(f"t{k}") for k in (1, 2)])
    said = labels.groupBy("doc_id").agg(F.max(c("quality") == 1).alias("good"), F.max(c("toxic") == 1).alias("toxic"))
    said = said.where("doc_id is not null")
    known = rows.join(said, "doc_id", "left").select("t1", "t2", "bits", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "doc_id")
    group = ["t1", "t2", "bits", "part", "good", "toxic"]
    by_id = known.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(c("doc_id").isNull(), c("n"))), F.lit(0)).alias("nameless"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("t1", "t2"))  # a row for each part and label of a text
    fails = c("n") - c("nameless") - F.when(c("least") == c("first"), c("at_least")).otherwise(0)
    split = by_text.withColumn("first", first).withColumn("again", fails)
    cells = F.array(F.struct(c("bits").alias("mask"), (c("n") - c("again")).alias("n")), F.struct((c("bits") + 16).alias("mask"), c("again").alias("n")))
    return split.select("part", "good", "toxic", F.explode(cells).alias("cell")).select("part", "good", "toxic", "cell.*").where("n > 0")


def signed(n: Column, shared: Column) -> Column:
    return F.when(F.bit_count(shared) % 2 == 0, n).otherwise(-n)


def parity_sums(rows: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic, sums: one signed sum for each subset of the filters."""
    sums = [F.sum(signed(c("n"), c("mask").bitwiseAND(F.lit(s)))) for s in range(1 << filters)]
    return rows.groupBy("part", "good", "toxic").agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).select("part", "good", "toxic", F.array(*[f"s{k}" for k in range(1 << filters)]).alias("sums"))


def inverse(sums: Column, filters: int) -> Column:
    """The counts by mask from their parity sums; the division is exact."""
    subsets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    total = lambda m: F.aggregate(subsets, F.lit(0).cast("long"), lambda a, s: a + signed(F.get(sums, s), m.bitwiseAND(s)))
    return F.transform(subsets, lambda m: F.struct(m.alias("mask"), F.shiftright(total(m), filters).alias("n")))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step from rows of part, good, toxic, mask and n; bit k is the k-th filter."""
    k = len(filters)
    sums = saved(parity_sums(rows, k), "parity-sums")
    cells = sums.select("part", "good", "toxic", F.explode(inverse(c("sums"), k)).alias("cell")).select("part", "good", "toxic", "cell.*")
    by_mask = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(c(x), c("n")).otherwise(0)).alias(x) for x in ("good", "toxic")])
    parts = by_mask.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # a cell for each mask

    orders = ["".join(p) for p in itertools.permutations(filters)]
    steps = parts.select("part", "cells", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    steps = steps.withColumn("bit", F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), c("letter")))
    earlier = reduce(lambda a, b: a + b, [F.when(F.instr("filter_order", f) <= c("at"), 1 << i).otherwise(0) for i, f in enumerate(filters)])
    steps = steps.withColumn("earlier", earlier)

    def total(value: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), x[value]).otherwise(F.lit(0).cast("long")))

    has = lambda m, what: m.bitwiseAND(c(what)) != 0
    removed = lambda m: has(m, "bit") & ~has(m, "earlier")
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(has(x["mask"], "bit"), x["n"] * (F.lit(math.factorial(k)) / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", (c("at") + 1).cast("int").alias("step"),
        total("n", lambda m: ~has(m, "bit") & ~has(m, "earlier")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: has(m, "bit") & has(m, "earlier")).alias("redundant"),
        total("n", lambda m: m == c("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audited(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The audit of the five filters over ``df``, with labels by document."""
    docs = pick(df, doc_id=doc_id, text=text, lang=lang)
    return audit(masks(docs, pick(labels, doc_id=doc_id, quality=quality, toxic=toxic)))

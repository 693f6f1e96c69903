"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Per document a few integer signals are taken with built-in functions. Their distribution in
each (language, source) is kept as a log-linear histogram: a bucket holds values within 1/32
of each other, and two sketches merge by adding the counts of equal buckets, so Spark builds
them with partial sums whatever the size of a source. Small sources borrow: a group of fewer
than ``min_rows`` documents uses its language's merged sketch, a small language that of all
documents. Fences at the quartiles plus ``reach`` times their distance replace fixed
cutoffs; a join brings each document its group's fences.

Only DataFrame functions are used. Defined results: a null text counts as empty; documents
without words fail the base rule; null languages and sources are groups of their own;
repeated rows are judged alike; an empty table gives an empty result.

Windows of five words are compared by 64-bit hashes within one text; two of n different
windows collide with probability n * n / 2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, saved

#: Signals with an upper fence; mean_length has a lower one as well.
SIGNALS = ["symbols", "mean_length", "dup_lines", "repeats"]
#: Fences lie this many quartile distances outside the quartiles.
REACH = 4
#: Least distance that counts, by signal (symbols, lines and words per thousand; hundredths of a character).
LEAST = {"symbols": 20, "mean_length": 40, "dup_lines": 40, "repeats": 25}
#: Documents that a group needs for thresholds of its own.
MIN_ROWS = 100
#: Copies of each threshold row, so that one source's documents spread over tasks.
SALTS = 16


def signals(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, the base counts and n_lines (lines with a word)."""
    docs = pick(df, doc_id=doc_id, lang=lang, source=source, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select(
        "*",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    word = lambda i, k: F.get("words", i + k)
    docs = docs.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2), word(i, 3), word(i, 4))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    # Most texts repeat no window; only the others sort their windows with the places.
    docs = docs.withColumn("repeats_some", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("placed", F.when(F.col("repeats_some"), placed))
    same = lambda x, k, step: F.coalesce(F.get("placed", k + step)["h"] == x["h"], F.lit(False))
    found = F.filter("placed", lambda x, k: same(x, k, -1) | same(x, k, 1))
    docs = docs.withColumn("repeated", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "repeated",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    return docs.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rated(base: DataFrame) -> DataFrame:
    """Adds the signals as integers, and base_failed."""
    per = lambda a, n, k: F.expr(f"coalesce({k} * {a} div nullif({n}, 0), 0)")
    return base.select(
        "*",
        per("n_symbols", "n_words", 1000).alias("symbols"),
        per("word_chars", "n_words", 100).alias("mean_length"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        per("n_repeat_words", "n_words", 1000).alias("repeats"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def bucket_of(v: str) -> Column:
    """A value's bucket: itself below 64, then 32 buckets for each power of two."""
    e = f"(length(bin({v})) - 1)"
    return F.expr(f"case when {v} < 64 then {v} else 64 + ({e} - 6) * 32 + (shiftright({v}, {e} - 5) - 32) end").cast("long")


def value_of(b: str) -> Column:
    """The least value of a bucket."""
    e = f"cast(6 + ({b} - 64) div 32 as int)"
    return F.expr(f"case when {b} < 64 then {b} else shiftleft(32 + ({b} - 64) % 32, {e} - 5) end").cast("long")


def sketches(base: DataFrame, keys: list[str]) -> DataFrame:
    """Sketch rows of documents that pass the base rule: keys, signal, bucket, n."""
    each = base.where("not base_failed").select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bucket_of(s).alias("bucket")) for s in SIGNALS])).alias("x"))
    return each.groupBy(*keys, "x.signal", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding counts of equal buckets."""
    return sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """One row per group: group_rows, and low_<signal>, high_<signal> for every signal."""
    group = Window.partitionBy(*keys, "signal")
    ranked = sketch.select("*", F.sum("n").over(group).alias("rows"), F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "signal").agg(F.max("rows").alias("rows"), quartile(1).alias("b1"), quartile(3).alias("b3"))
    quartiles = quartiles.select(*keys, "signal", "rows", value_of("b1").alias("q1"), value_of("b3").alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for s in SIGNALS for x in (s, LEAST[s])]), F.col("signal"))
    distance = reach * F.greatest(F.col("q3") - F.col("q1"), least)
    placed = quartiles.select(*keys, "rows", "signal", (F.col("q1") - distance).alias("low"), (F.col("q3") + distance).alias("high"))
    picked = [F.max(F.when(F.col("signal") == s, F.col(side))).alias(f"{side}_{s}") for s in SIGNALS for side in ("low", "high")]
    return placed.groupBy(*keys).agg(F.max("rows").alias("group_rows"), *picked)


def thresholds(base: DataFrame, *, min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """Fences of every (lang, source), from its own sketch or the merged one that has enough rows."""
    own = saved(sketches(base, ["lang", "source"]), "sketches")
    by_lang = merged(own, ["lang"])
    bounds = [f"{side}_{s}" for s in SIGNALS for side in ("low", "high")]
    renamed = lambda df, tag: df.select(*[F.col(c).alias(c if c in ("lang", "source") else f"{tag}_{c}") for c in df.columns])
    g = renamed(fences(own, ["lang", "source"], reach), "own")
    m = renamed(fences(by_lang, ["lang"], reach), "lang").withColumnRenamed("lang", "lang_key")
    a = renamed(fences(merged(by_lang, []), [], reach), "all").withColumn("one", F.lit(1))  # a single row
    joined = g.join(m, F.col("lang").eqNullSafe(F.col("lang_key"))).withColumn("one", F.lit(1)).join(F.broadcast(a), "one")
    choose = lambda c: F.when(F.col("own_group_rows") >= min_rows, F.col(f"own_{c}")).when(F.col("lang_group_rows") >= min_rows, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    return joined.select("lang", "source", *[choose(c).alias(c) for c in bounds])


def judge(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS, reach: int = REACH) -> DataFrame:
    """One row per document: base counts, base_failed, the signals and kept."""
    base = saved(rated(signals(df, doc_id=doc_id, text=text, lang=lang, source=source)), "signals")
    limits = thresholds(base, min_rows=min_rows, reach=reach)
    limits = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    limits = limits.withColumnRenamed("lang", "t_lang").withColumnRenamed("source", "t_source").withColumnRenamed("salt", "t_salt")
    salted = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt"))
    joined = salted.join(limits, same, "left")
    within = F.col("mean_length") >= F.col("low_mean_length")
    for s in SIGNALS:
        within = within & (F.col(s) <= F.col(f"high_{s}"))
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *SIGNALS,
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
    )

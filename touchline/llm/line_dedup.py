"""Line dedup: lines that many documents hold go from all but one of them.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted for each
hash; lines over the threshold are dropped, but in the largest id that holds one; texts are
put together again by the lines' positions.

Only hashes and places cross the shuffles of counting and marking; whole texts cross one, to
meet their dropped positions. A line in a third of all documents is counted by (hash, document)
first and then by hash, each with partial sums before its shuffle. Such frequent lines are met
by broadcast: a line with a HOT-th of all long lines or more can be one of HOT at most. All
others are met by a shuffled join, in which no key has more than that share.

Defined results: a null or empty text is one empty line; a null text stays null. Ids are what
tells documents apart: rows of one id are one document, rows without an id together are another
one, whose id comes before all others. Repeated lines of the largest document all stay. A
text whose lines all go is empty. Texts and lines of any length are worked on whole. An empty
table gives no rows. Further columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pick, saved

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines that are broadcast at most.
HOT = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does that for ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, two hashes of the row's text, place (from 0), and two hashes of the line's key, for long keys."""
    own = [F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(f"t{k}") for k in (1, 2)]
    lines = docs.select("doc_id", *own, F.posexplode(split_lines(F.col("text"))).alias("place", "line"))
    keyed = lines.where(F.octet_length("line") >= min_chars).select("doc_id", "t1", "t2", "place", lowered(F.btrim("line", F.lit(SPACES))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "place", *[F.xxhash64(F.lit(k), "key").alias(f"h{k}") for k in (1, 2)])


def repeated(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, keep (the largest document), n (lines) of keys that at least ``min_docs`` documents hold."""
    by_document = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    by_key = by_document.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep"), F.sum("n").alias("n"))
    return by_key.where(F.col("docs") >= min_docs).select("h1", "h2", "keep", "n")


def dropped(lines: DataFrame, keys: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, t1, t2 and the sorted places of the lines that go."""
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * hot >= total  # the shares add up to one, so these are ``hot`` keys at most
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("keep"))
    few = keys.where(frequent).select("h1", "h2", "keep", F.lit(True).alias("met"))
    met = lines.join(F.broadcast(few), ["h1", "h2"], "left")
    found = met.where("met").where(elsewhere)
    rest = met.where("met is null").drop("keep", "met").join(keys.where(~frequent).select("h1", "h2", "keep"), ["h1", "h2"]).where(elsewhere)
    places = [x.select("doc_id", "t1", "t2", "place") for x in (found, rest)]
    return places[0].unionByName(places[1]).groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """Lines but those at the sorted places ``gone``, joined: the runs between them, in time linear in the lines."""

    def runs(r: Column) -> Column:
        first = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(r["gone"], i - 1) + 1)
        end = lambda i: F.coalesce(F.get(r["gone"], i), F.size(r["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(r["gone"])), lambda i: F.slice(r["lines"], first(i) + 1, end(i) - first(i))))

    # Bound once, so that the text is not split again for each run.
    once = F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), runs)
    return F.array_join(F.get(once, F.lit(0)), "\n")


def deduplicated(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each row: doc_id, text (without the lines that go), n_lines (before), n_dropped."""
    docs = pick(df, doc_id=doc_id, text=text)
    lines = saved(long_lines(docs, min_chars), "long-lines")
    places = dropped(lines, saved(repeated(lines, min_docs), "repeated-lines"))
    places = places.select(F.col("doc_id").alias("of_doc"), F.col("t1").alias("of_t1"), F.col("t2").alias("of_t2"), "gone")
    keyed = docs.select("*", *[F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(f"t{k}") for k in (1, 2)])
    both = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("t1") == F.col("of_t1")) & (F.col("t2") == F.col("of_t2")), "left")
    return both.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(split_lines(F.col("text")), F.col("gone"))).alias("text"),
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )

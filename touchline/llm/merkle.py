"""Merkle manifest of a data set: one root over all rows, and a proof for each row.

Leaves are numbered within their source by ranges: rows are sorted range by range, and only
the ranges' counts meet, so a source with a third of all rows is many tasks. Bottom-up, each
FAN consecutive nodes become their hash, level by level; every level is a table of its own,
whose rows keep their run of children. Top-down, each level's rows are joined to their parents
by (source, place div FAN): a child puts its siblings before the path that its parent got. A
parent has FAN children at most, so no join key is large, and texts cross no shuffle at all.
The sources' roots are the leaves of a tree of the same kind.

Defined results: a null value is hashed as '-', so null and empty differ; a null source comes
first, before the empty one, and is a source like any other; null ids come first; rows of one
id are ordered by their hash, and equal rows are leaves of their own, in any order, as they are
equal. Long texts are hashed whole. An empty table has no rows and no root. Further columns are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, saved
from .line_dedup import UPPER

#: Children of a node.
FAN = 16
c = F.col
PATH = "array<struct<left:string,right:string>>"


def framed(column: str | Column) -> Column:
    """``-`` for null, else the value's bytes as UTF-8, a colon, and the value."""
    value = (c(column) if isinstance(column, str) else column).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with idx (from 0) and n (rows) within ``grp``, in the order of ``order``.

    A range of the order is sorted in one task and written with each row's place in it. A row's
    own number is the last part of the order, so that equal rows can be cut apart as well.
    """
    by = [c("grp"), *[c(x).asc_nulls_first() for x in order], c("salt")]
    cut = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    placed = saved(cut.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    ranges = placed.groupBy("grp", "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    ahead = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select("grp", "part", (ahead - c("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    return placed.join(bases, ["grp", "part"]).withColumn("idx", c("at") + c("shift")).drop("part", "at", "shift")


def parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The level above: grp, idx, n, hash, run (the children's hashes). Groups of one node are done."""
    run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
    up = nodes.where("n > 1").select("grp", "idx", "n", "hash", F.expr(f"idx div {fan}").alias("up"))
    runs = up.groupBy("grp", "up").agg(run.alias("run"), F.max("n").alias("n"))
    return runs.select("grp", c("up").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.sha2(F.array_join("run", ""), 256).alias("hash"), "run")


def build(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves (grp, idx, n, hash), each a written table, and every group's root: grp, root."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(saved(parents(levels[-1], fan), "level"))
        most = -(-most // fan)
    roots = [level.where("n = 1").select("grp", c("hash").alias("root")) for level in levels]
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels[1:], saved(out, "roots")


def paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """Leaves with ``path``: their siblings (left, right) from the lowest level up, followed by their root's own path.

    ``above``: grp, path and further columns of each root, which go down to its leaves.
    """
    more = [x for x in above.columns if x not in ("grp", "path")]
    upper: DataFrame | None = None
    for level in [*reversed(levels), leaves]:
        placed = level.where("n = 1").join(above, "grp")
        if upper is not None:
            met = upper.select(c("grp"), c("idx").alias("up"), c("run").alias("siblings"), c("path").alias("rest"), *more)
            children = level.where("n > 1").withColumn("up", F.expr(f"idx div {fan}")).join(met, ["grp", "up"])
            at = F.expr(f"cast(idx % {fan} as int)")
            side = lambda first, length: F.array_join(F.slice("siblings", first, length), "")
            own = F.array(F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(fan)).alias("right"))).cast(PATH)
            placed = placed.unionByName(children.withColumn("path", F.concat(own, c("rest"))).drop("up", "siblings", "rest"))
        if level is leaves:
            return placed
        upper = saved(placed, "paths")
    raise AssertionError


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, leaf, lambda h, p: hashed(p["left"], h, p["right"]))


def tampered(doc_id: str, text: str) -> Column:
    """Texts of ids whose crc32 5 divides, with A-Z in lower case; all others as they are."""
    hit = F.crc32(c(doc_id).cast("string")) % 5 == 0
    return F.when(hit, F.translate(text, UPPER, UPPER.lower())).otherwise(c(text))


def manifest(
    df: DataFrame, *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text",
    fan: int = FAN, tampering: Column | None = None,
) -> DataFrame:
    """One row for each row: doc_id, leaf, subroot, root, path, and folded_root of the leaf after ``tampering`` (a text; none: as it is)."""
    docs = pick(df, doc_id=doc_id, source=source, lang=lang, n_chars=n_chars, text=text)
    digest = lambda value: hashed(*[framed(x) for x in ("doc_id", "source", "lang", "n_chars")], framed(value))
    changed = digest(tampering) if tampering is not None else F.lit(None).cast("string")
    if tampering is not None:
        changed = F.when(~tampering.eqNullSafe(c("text")), changed)
    # A source's key: no null, and in the order of null first, then bytes.
    grp = F.coalesce(F.concat(F.lit("s"), c("source").cast("string")), F.lit("-"))
    leaves = saved(docs.select(grp.alias("grp"), "doc_id", digest(c("text")).alias("hash"), changed.alias("changed")), "leaves")
    leaves = saved(numbered(leaves, "doc_id", "hash"), "numbered-leaves")
    levels, subroots = build(leaves, fan)

    tops = saved(numbered(subroots.select(F.lit("").alias("grp"), c("grp").alias("of"), c("root").alias("hash")), "of"), "sources")
    top_levels, root = build(tops, fan)
    none = F.array().cast(PATH)
    above = paths(tops, top_levels, root.select("grp", "root", none.alias("path")), fan)
    above = saved(above.select(c("of").alias("grp"), c("hash").alias("subroot"), "root", "path"), "source-paths")
    placed = paths(leaves, levels, above, fan)
    return placed.select("doc_id", c("hash").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("changed", "hash"), c("path")).alias("folded_root"))


def proof(path: Column) -> Column:
    """The siblings of a path, left to right, level by level."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")

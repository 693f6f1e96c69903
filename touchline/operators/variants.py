"""Semi-structured values as VARIANT: paths, equality that tolerates types, and names at any depth, without a declared structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import DENIED

c = F.col
NUMBER = r"^-?\d+(\.\d+)?$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T"
DAY = r"^\d{4}-\d{2}-\d{2}$"
NESTED = "^(OBJECT|ARRAY)"


def parsed(text: Column) -> Column:
    """JSON as a variant; null where it doesn't parse."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str) -> Column:
    """The value at a path (``$.a.b[0]``), as a type; null where there is none or it doesn't fit."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def canonical(value: Column) -> Column:
    """A variant as text with its names in order, the same whatever the order they came in."""
    return F.to_json(value)


def same(a: Column, b: Column) -> Column:
    """Whether two variants are the same value: numbers as numbers also where one is a text, times as instants, objects by their names.

    Missing and null are the same, and neither equals anything else.
    """
    text = lambda v: F.try_variant_get(v, "$", "string")
    missing = lambda v: v.isNull() | F.is_variant_null(v)
    nested = lambda v: kind_of(v).rlike(NESTED)
    ta, tb = text(a), text(b)
    as_number = lambda t: F.when(t.rlike(NUMBER), t.cast("double"))
    both = lambda pattern: ta.rlike(pattern) & tb.rlike(pattern)
    instant = lambda t: F.unix_micros(F.try_to_timestamp(t))
    plain = F.when(both(NUMBER), as_number(ta) == as_number(tb)).when(both(INSTANT), instant(ta).eqNullSafe(instant(tb))).when(ta.rlike(INSTANT) & tb.rlike(DAY), F.substring(ta, 1, 10) == tb).when(tb.rlike(INSTANT) & ta.rlike(DAY), F.substring(tb, 1, 10) == ta).otherwise(ta == tb)
    structured = canonical(a) == canonical(b)
    return F.when(missing(a) | missing(b), missing(a) & missing(b)).when(nested(a) | nested(b), structured).otherwise(F.coalesce(plain, F.lit(False)))


def leaves(df: DataFrame, key: str, value: str, deepest: int = 64) -> DataFrame:
    """Every named or placed value inside a variant: key, path, name, depth, value, nested.

    One step opens one level of all rows by a lateral join with the variant's own entries; there are as
    many steps as the deepest value has levels. Values deeper than ``deepest`` levels raise.
    """
    spark = df.sparkSession
    level = df.select(c(key).alias("key"), F.lit("$").alias("path"), c(value).alias("value"))
    out: DataFrame | None = None
    for depth in range(1, deepest + 2):
        level = level.where(kind_of(c("value")).rlike(NESTED))
        if level.isEmpty():
            break
        if depth > deepest:
            raise ValueError(f"values lie deeper than {deepest} levels")
        inside = level.lateralJoin(spark.tvf.variant_explode(c("value").outer()).toDF("pos", "name", "inner"))
        step = F.when(c("name").isNotNull(), F.concat(F.lit("."), c("name"))).otherwise(F.concat(F.lit("["), c("pos").cast("string"), F.lit("]")))
        found = inside.select("key", F.concat("path", step).alias("path"), "name", F.lit(depth).alias("depth"), c("inner").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = found.select("key", "path", "value")
    if out is None:
        return level.select("key", "path", F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"), "value", F.lit(False).alias("nested")).where("false")
    return out.withColumn("nested", kind_of(c("value")).rlike(NESTED))


def denied(df: DataFrame, key: str, value: str, pattern: str = DENIED) -> DataFrame:
    """Paths inside a variant whose names a model must not see, at any depth: key, path."""
    return leaves(df, key, value).where(c("name").rlike(pattern)).select("key", "path")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Top-level names whose value differs between two states of a row: key, name, old_value, new_value as text."""
    spark = old.sparkSession
    opened = lambda df, tag: df.select(c(key).alias("key"), c(value).alias("v")).lateralJoin(spark.tvf.variant_explode(c("v").outer()).toDF("pos", "name", tag)).select("key", "name", tag)
    both = opened(old, "old").join(opened(new, "new"), ["key", "name"], "full")
    return both.where(~same(c("old"), c("new"))).select("key", "name", canonical(c("old")).alias("old_value"), canonical(c("new")).alias("new_value"))

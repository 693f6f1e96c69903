"""Data-quality rules as one table of violations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """rule and key of every row that breaks a rule (a predicate that must hold); one scan for all rules. Missing counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), c(key).cast("string").alias("key"))


def summary(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule."""
    wide = df.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(name) for name, p in rules.items()])
    return wide.unpivot([], list(rules), "rule", "broken").withColumn("passed", c("broken") == 0)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Keys of the child that the parent lacks, with how often."""
    missing = child.where(c(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n"))
    return missing.join(parent.select(c(parent_key).alias(child_key)), child_key, "left_anti")


def references(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Orphans of several references: reference, keys, n_rows."""
    each = [orphans(*x).agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("reference"), "keys", "n_rows") for name, x in checks.items()]
    return reduce(DataFrame.unionByName, each)


def frozen(old: DataFrame, new: DataFrame, key: str, fields: list[str], once: list[str]) -> DataFrame:
    """Breaches between two states: removed rows, changed frozen fields, rewritten write-once fields."""
    both = old.select(key, *[c(f).alias(f"old_{f}") for f in [*fields, *once]]).join(new.select(key, *fields, *once, F.lit(True).alias("there")), key, "left")
    breaches = [F.when(c("there").isNull(), F.lit("removed"))]
    breaches += [F.when(c("there") & ~c(f).eqNullSafe(c(f"old_{f}")), F.lit(f"{f} changed")) for f in fields]
    breaches += [F.when(c("there") & c(f"old_{f}").isNotNull() & ~c(f).eqNullSafe(c(f"old_{f}")), F.lit(f"{f} rewritten")) for f in once]
    return both.select(key, F.explode(F.filter(F.array(*breaches), lambda x: x.isNotNull())).alias("breach"))


#: Names that must not be inputs of a model.
DENIED = r"(?i)(odds|price|stake|bookmaker|market_value|closing)"


def leaks(df: DataFrame) -> list[str]:
    """Columns, nested ones too, whose names a model must not see."""
    found: list[str] = []

    def walk(dtype, path: str) -> None:
        if hasattr(dtype, "fields"):
            for f in dtype.fields:
                if re.search(DENIED, f.name):
                    found.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif hasattr(dtype, "elementType"):
            walk(dtype.elementType, path)
        elif hasattr(dtype, "valueType"):
            walk(dtype.valueType, path)

    walk(df.schema, "")
    return found


def require_no_leaks(df: DataFrame) -> DataFrame:
    if found := leaks(df):
        raise ValueError(f"a model may not read {found}")
    return df

"""Reviewed registries: JSON documents of entries, loaded under an enforced schema, with every entry that isn't taken reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: An entry of the reviewed team crosswalk.
CROSSWALK = "provider string, external_id string, same_as struct<provider: string, external_id: string>, reviewer string, evidence array<string>"
REQUIRED = {"provider": "provider is not null", "external_id": "external_id is not null", "same_as": "same_as.provider is not null and same_as.external_id is not null", "reviewer": "reviewer is not null", "evidence": "size(evidence) > 0"}


def load(spark: SparkSession, path: str, schema: str = CROSSWALK, required: dict[str, str] | None = None, keys: tuple[str, ...] = ("provider", "external_id")) -> DataFrame:
    """One row for each entry of each document below ``path``: file, registry_version, place, the entry's fields, and problem.

    A document is an object with registry_version and entries, over any number of lines. Entries are
    read one by one, so a bad one spoils no other. ``problem`` is null for entries that count; else it
    says why not: a document that doesn't parse or has no entries, an entry that doesn't fit the
    schema, one that lacks a field, or one whose key an earlier entry of the newest version has.
    """
    required = REQUIRED if required is None else required
    documents = spark.read.schema("registry_version string, entries array<string>, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    named = documents.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "registry_version", "entries", "_broken")
    state = F.when(c("_broken").isNotNull(), "broken document").when(c("registry_version").isNull(), "no version").when(c("entries").isNull(), "no entries")
    told = named.withColumn("document_problem", state)
    each = told.select("file", "registry_version", "document_problem", F.posexplode_outer(F.when(c("document_problem").isNull(), c("entries"))).alias("place", "entry"))
    fields = [x.strip().split(" ")[0] for x in _top_level(schema)]
    parsed = each.withColumn("e", F.from_json("entry", f"{schema}, _misfit string", {"columnNameOfCorruptRecord": "_misfit", "mode": "PERMISSIVE"}))
    flat = parsed.select("file", "registry_version", "place", *[c(f"e.{f}").alias(f) for f in fields], c("e._misfit").alias("misfit"), "document_problem")
    # A text field takes an object as its text: that is no name.
    texts = [x.strip().split(" ")[0] for x in _top_level(schema) if x.strip().endswith(" string")]
    nested = F.exists(F.array(*[c(f) for f in texts]), lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)))
    lacking = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in required.items()]), lambda x: x.isNotNull()), ",")
    judged = flat.withColumn("problem", F.when(c("document_problem").isNotNull(), c("document_problem")).when(c("misfit").isNotNull() | nested, "misfit").when(lacking != "", F.concat(F.lit("lacks "), lacking)))
    # Only sound entries compete for a key: the newest version's first.
    order = Window.partitionBy(*keys, c("problem").isNull()).orderBy(F.desc("registry_version"), "file", "place")
    ranked = judged.withColumn("k", F.row_number().over(order))
    return ranked.select("file", "registry_version", "place", *fields, F.coalesce("problem", F.when(c("k") > 1, "duplicate")).alias("problem"))


def _top_level(schema: str) -> list[str]:
    """The columns of a DDL, nested commas left alone."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def accepted(entries: DataFrame) -> DataFrame:
    """The entries that count: a dimension with one row for each key."""
    return entries.where("problem is null").drop("problem")

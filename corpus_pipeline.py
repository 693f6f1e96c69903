"""From raw documents to packed training sequences, by the operators of touchline.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of documents; toxic documents, near duplicates and contaminated
documents go, and remaining benchmark passages and personal values are taken out of the
texts. The last returns one row per packed piece, with its token ids.

Defined results, for every stage: a null text counts as an empty one and stays null; an empty
or null text is never toxic by more than the model's bias, never a near duplicate, never
contaminated, holds no personal value, and is packed as its end token alone. Rows with a null
or a repeated id are rows like any other, but near duplicates of each other are one group, of
which the row with the least id (ids before null, then the earlier row) stays. Long texts are
worked on whole. An empty table gives an empty table. Further columns pass through, whatever
their names; a column that differs from doc_id, text or n_chars by case alone is one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, jaccard_join, packing, pseudonyms, toxicity
from touchline.llm.common import bounded_batches, crc_of, pick, saved, scratch


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under plain names, so that none clashes with ours, and the names."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    at: dict[str, str] = {}
    for name, plain in zip(docs.columns, names):
        at.setdefault(name, plain)
    return docs.toDF(*names), at


def _with_text(df: DataFrame, docs: DataFrame, at: dict[str, str], text: Column, changed: Column) -> DataFrame:
    """The columns of docs, with a new text; n_chars follows a text that changed."""
    columns = []
    for i, field in enumerate(docs.schema.fields):
        old = F.col(f"in_{i}")
        if f"in_{i}" == at["text"]:
            old = text
        elif f"in_{i}" == at.get("n_chars"):
            old = F.when(changed, F.length(text).cast(field.dataType)).otherwise(old)
        columns.append(old.alias(field.name))
    return df.select(*columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half."""
    bounded_batches(spark)
    labels = pick(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="doc_id", label="toxic")
    learned = F.coalesce(crc_of("doc_id") % 5 != 0, F.lit(True)) & F.col("label").isNotNull()
    model = toxicity.fit(toxicity.with_labels(pick(docs, doc_id="doc_id", text="text"), labels.where(learned)))
    plain, at = _plain(docs)
    scored = toxicity.score(plain, model, text=at["text"], column="score")
    return scored.where("score < 0.5").drop("score").toDF(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near duplicates: the one with the smallest id, ids before null.

    Rows are told apart by a number of their own, as ids may be null or repeated; it is written
    down with the rows, so that a repeated task can't number them anew.
    """
    bounded_batches(spark)
    plain, at = _plain(docs)
    rows = saved(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    doc_id = F.col(at["doc_id"]).cast("long")
    linked = jaccard_join.link(rows, doc_id="row", text=at["text"], percent=80).select(F.col("doc_id").alias("linked"), "component_id")
    # Most rows are alone in their component.
    shared = saved(linked.where("component_id <> linked").select("linked", "component_id"), "near-duplicates")
    shared = shared.unionByName(shared.select(F.col("component_id").alias("linked"), "component_id").distinct())
    members = rows.select("row", doc_id.alias("id")).join(shared, F.col("row") == F.col("linked"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("row"))
    first = members.groupBy("component_id").agg(F.min(order)["row"].alias("first"))
    gone = saved(shared.join(first, F.col("linked") == F.col("first"), "left_anti").select(F.col("linked").alias("gone")), "gone")
    few = gone.count() <= jaccard_join.BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, F.col("row") == F.col("gone"), "left_anti")
    return kept.drop("row").toDF(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents (a twentieth of the words hit), and without the passages hit in others."""
    bounded_batches(spark)
    plain, at = _plain(docs)
    clean = decontaminate.decontaminate(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=at["text"], window=13, changed="changed")
    return _with_text(clean, docs, at, F.col(at["text"]), F.col("changed"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced within their formats, under the session's key."""
    bounded_batches(spark)
    plain, at = _plain(docs)
    new = pseudonyms.pseudonymise(plain.withColumn("body", F.col(at["text"])), text="body", key=pseudonyms.session_key(spark))
    return _with_text(new, docs, at, F.col("body"), ~F.col("body").eqNullSafe(F.col(at["text"])))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own."""
    bounded_batches(spark)
    return packing.pack(docs, longest=1024, cache_entries=CACHE_ENTRIES)


#: The tokenizer's cache in a worker: smaller than alone, as executors hold what earlier stages have left.
CACHE_ENTRIES = 150_000

STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""The pipeline's stages on small tables, each against a plain version of its decision."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm.common import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("doc_tokens")).collect()
    assert got and all(r["n"] == r["doc_tokens"] for r in got)


def test_near_duplicates(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {d for d, (_, c) in brute.components(rows).items() if c == d}
    out = corpus_pipeline.remove_near_duplicates(spark, documents, SF)
    assert out.columns == documents.columns and {r["doc_id"] for r in out.collect()} == want


def test_one_row_of_each_group_stays_whatever_its_ids(spark, documents):
    """Repeated rows of an id, rows without ids and two texts of one id."""
    a, b, d = ("".join(f"{x}{k} " for k in range(40)) for x in "abd")
    rows = [(5, a)] * 3 + [(7, a), (None, a), (None, b), (None, b), (None, b + "end"), (9, d), (9, "another text of the same id"), (8, d + "end"), (None, None), (None, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t) if t else None) for k, t in rows], documents.schema).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.remove_near_duplicates(spark, df, SF).collect()]
    assert sum(k is None and (t or "").startswith("b0 ") for k, t in got) == 1
    rest = [r for r in got if not (r[0] is None and r[1])]
    assert sorted(rest, key=str) == sorted([(5, a), (9, "another text of the same id"), (8, d + "end"), (None, None), (None, None), (4, ""), (4, "")], key=str)


def test_decontamination(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    out = {r["doc_id"]: r for r in corpus_pipeline.decontaminate_benchmark(spark, documents, SF).collect()}
    for r in documents.collect():
        n, hit, _ = brute.hits(r["text"], items)
        assert (r["doc_id"] in out) == (not (hit and 20 * hit >= n))
        if r["doc_id"] in out:
            assert out[r["doc_id"]]["text"] == r["text"] if not hit else brute.hits(out[r["doc_id"]]["text"], [])[0] == n - hit


def test_stages_take_odd_tables(spark, documents):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "de", None, 0), (3, "x" * 20_000, "en", "s", 20_000)], documents.schema)
    odd = odd.select("*", F.lit(1).alias("score"), F.lit(2).alias("hit_spans"), F.lit("clash").alias("Text"))
    for table in (odd, odd.limit(0)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns and out.count() == n, name
        assert corpus_pipeline.pack(spark, table, SF).select("length").count() >= n


def test_new_names_do_not_change_results(spark, documents):
    path = scratch(spark, "docs")
    corpus_pipeline.pseudonymise(spark, documents, SF).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == documents.count() and back.dtypes == documents.dtypes

"""The thin queries of the text operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, jaccard_join, katz, line_dedup, merkle, packing, pseudonyms, quality_rules, separator_scan, sharding, sql, token_files, toxicity
from .common import bounded_batches, crc_of, pick, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files, and their token counts found again by their separators."""
    path = scratch(spark, "flat-tokens")
    separator_scan.write_flat(table(spark, sf_dir, "documents"), path)
    return separator_scan.scan_flat(spark, path)


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules whose thresholds follow each language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the personal values in their texts replaced within their formats."""
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), key=pseudonyms.session_key(spark))


def op4_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of patched frame-of-reference blocks, read back."""
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-files"))
    back = token_files.read_tokens(spark, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a model of those outside the held-out seventh."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return katz.score(docs.withColumn("held_out", F.coalesce(crc_of("doc_id") % 7 == 2, F.lit(False))))


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces of power-of-two lengths, written to a folder for each length and read back."""
    pieces = packing.bucketed(packing.pack(table(spark, sf_dir, "documents"), longest=1024), scratch(spark, "buckets"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_char_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", label="toxic")
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    model = toxicity.fit(toxicity.with_labels(docs, labels.where(~held_out & F.col("label").isNotNull())))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in occurrences of benchmark windows."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), window=13)
    n_hit = decontaminate.hit_count()
    n_words = F.col("hit_words").cast("long")
    return hits.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shuffled into 16 shards whose counts differ by one at most, read back from them."""
    shards = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return shards.select(
        "doc_id",
        sharding.size_of().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_join.link(table(spark, sf_dir, "documents"), percent=80)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them hold, but in the last that holds one."""
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_walsh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language, from Walsh-Hadamard sums."""
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and whether a fifth of them, tampered with, still verify."""
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampering=merkle.tampered("doc_id", "text"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {
        "op1_separator_scan": op1_separator_scan,
        "op2_adaptive_quality": op2_adaptive_quality,
        "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
        "op4_patched_blocks": op4_patched_blocks,
        "op5_katz_backoff": op5_katz_backoff,
        "op6_power_of_two_packing": op6_power_of_two_packing,
        "op7_char_ngram_toxicity": op7_char_ngram_toxicity,
        "op8_suffix_automaton": op8_suffix_automaton,
        "op9_two_pass_shuffle": op9_two_pass_shuffle,
        "op10_partenum_join": op10_partenum_join,
        "op11_line_dedup": op11_line_dedup,
        "op12_walsh_audit": op12_walsh_audit,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """SQL knows no tokenizer, keyed hash, model fit or seeded shuffle; the other queries' tests are against plain versions."""
    return {"op2_adaptive_quality": sql.quality(), "op8_suffix_automaton": sql.HITS, "op10_partenum_join": sql.LINKS, "op11_line_dedup": sql.LINES, "op12_walsh_audit": sql.AUDIT, "op13_merkle_manifest": sql.merkle()}

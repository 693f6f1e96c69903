"""Every registered text query on a small table: its contract's columns, and its SQL or a plain version."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[1]))
from parity import difference, duck  # noqa: E402

from touchline.llm import queries, quality_rules, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_separator_scan": "n_tokens",
    "op2_adaptive_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_feistel_pseudonyms": "doc_id text",
    "op4_patched_blocks": "doc_id start n_tokens ids_crc32",
    "op5_katz_backoff": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_power_of_two_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_char_ngram_toxicity": "doc_id held_out score predicted",
    "op8_suffix_automaton": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_two_pass_shuffle": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_partenum_join": "doc_id n_shingles component_id",
    "op11_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op12_walsh_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def encoded(documents):
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in documents}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_sql(spark, documents, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if sql := queries.oracle_sql().get(name):
        assert difference(df, sql, duck(SF)) == ""
    elif name != "op6_power_of_two_packing":
        assert df.count() == len(documents)


def test_token_files_against_the_tokenizer(spark, encoded):
    at = 0
    for r in queries.op4_patched_blocks(spark, SF).orderBy("doc_id").collect():
        ids = encoded[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids))
        at += len(ids)


def test_packing_against_the_tokenizer(spark, encoded):
    pieces = defaultdict(list)
    for r in queries.op6_power_of_two_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == brute.crc(encoded[r["doc_id"]][r["start"] :][: r["length"]])
    for d, ids in encoded.items():
        assert sum(r["length"] for r in pieces[d]) == len(ids) and {r["doc_tokens"] for r in pieces[d]} == {len(ids)}


def test_shards_against_plain_counts(spark, documents):
    got = queries.op9_two_pass_shuffle(spark, SF).collect()
    texts = dict(documents)
    slots = defaultdict(list)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len({len(x) for x in slots.values()}) <= 2


def test_fences_follow_each_source_and_every_signal_rejects(spark):
    """Two sources with different habits, and one odd document for each signal."""
    words = lambda k, n: " ".join(f"w{k}x{j}yz" for j in range(n))
    rows = [(k, words(k, 40), "en", "plain") for k in range(200)]
    rows += [(1000 + k, "\n".join(f"{words(10 * (1000 + k) + j, 9)} {'#' * ((k + j) % 9)}" for j in range(4)), "en", "marked") for k in range(200)]
    bad = {
        "symbols": "$$ " * 9 + words(1, 60),
        "mean_length": " ".join("verylongword" * 4 + f"{j}" for j in range(40)),
        "dup_lines": "\n".join([words(2, 3), words(3, 12), words(2, 3), words(4, 12), words(5, 30)]),
        "repeats": words(6, 8) + " " + words(7, 70) + " " + words(6, 8),
    }
    rows += [(5000 + n, t, "en", "plain") for n, t in enumerate(bad.values())]
    base = quality_rules.saved(quality_rules.rated(quality_rules.signals(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))), "base")
    limits = {r["source"]: r.asDict() for r in quality_rules.thresholds(base).collect()}
    assert limits["marked"]["high_symbols"] > 2 * limits["plain"]["high_symbols"]
    over = {r["doc_id"]: r for r in base.where("doc_id >= 5000").collect()}
    for n, signal in enumerate(bad):
        assert not over[5000 + n]["base_failed"] and over[5000 + n][signal] > limits["plain"][f"high_{signal}"], (signal, over[5000 + n], limits["plain"])
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[k] == (k < 5000) for k in kept)


@pytest.mark.parametrize("n", [99, 100])
def test_small_groups_borrow_their_languages_sketch(spark, n):
    """Below MIN_ROWS rows the group's own habit doesn't count."""
    words = lambda k, m: " ".join(f"w{k}x{j}yz" for j in range(m))
    rows = [(k, words(k, 40), "en", "large") for k in range(400)] + [(1000 + k, words(k, 40) + "".join(f" {j}#" for j in range(k % 30)), "en", "small") for k in range(n)]
    base = quality_rules.saved(quality_rules.rated(quality_rules.signals(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))), "base")
    limits = {r["source"]: r["high_symbols"] for r in quality_rules.thresholds(base).collect()}
    assert (limits["small"] == limits["large"]) == (n < quality_rules.MIN_ROWS)

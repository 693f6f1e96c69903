"""Katz backoff against a plain dictionary version, and its sums of probabilities."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import katz


def brute(rows):
    """(doc_id, text, held_out) -> {doc_id: (n_tokens, n_known, N, base, score)}, and the model's p(word, context)."""
    words = lambda t: [*(t or "").encode().lower().split(), b"</s>"]
    uni, pairs = Counter(), Counter()
    texts = 0
    for _, t, held in rows:
        if not held:
            texts += 1
            w = words(t)
            uni.update(w)
            pairs.update(zip([b"<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    n_r = Counter(uni.values())
    model = katz.Unigrams.of(n, v, texts, [n_r[r] for r in range(1, katz.K + 2)])
    m_r = Counter(pairs.values())
    d = katz.discounts([m_r[r] for r in range(1, katz.K + 2)])
    after = defaultdict(dict)
    for (a, b), c in pairs.items():
        after[a][b] = c

    def p1(w):
        c = uni[w]
        return (model.d[c] if c <= katz.K else 1) * c / model.total if c else model.unknown

    cached = {}

    def p(w, h):
        c_h = texts if h == b"<s>" else uni[h]
        if not c_h:
            return p1(w)
        kept = {b: (d[c] if c <= katz.K else 1) * c for b, c in after[h].items()}
        whole = c_h if any(d[c] < 1 for c in after[h].values() if c <= katz.K) else c_h + 1
        if w in kept:
            return kept[w] / whole
        if h not in cached:
            cached[h] = (whole - sum(kept.values())) / whole / (1 - sum(map(p1, kept)))
        return cached[h] * p1(w)

    out = {}
    for key, t, _ in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p(x, h)) for h, x in zip([b"<s>", *w], w))
        out[key] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out, p, list(uni)


def made(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), k % 7 == 2) for k in range(docs)]
    return rows + [(1000, None, False), (1001, "", True), (1002, "Unseen words ONLY here zz", True), (1003, "w1 w2 w3 " * 300, False), (1004, "the " * 50, False)]


@pytest.mark.parametrize("block_tokens,bucket_tokens", [(4_000_000, 2_000_000), (300, 50)])
def test_matches_brute_force(spark, block_tokens, bucket_tokens):
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("score", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in katz.score(df, block_tokens=block_tokens, bucket_tokens=bucket_tokens).collect()}
    want, p, vocabulary = brute(rows)
    assert len(got) == len(rows)
    for key, (n, known, total, base, score) in want.items():
        r = got[key]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)
    for context in [b"<s>", b"the", b"w1", b"w7", b"never"]:
        assert sum(p(w, context) for w in [*vocabulary, b"an unknown word"]) == pytest.approx(1)


def test_empty_and_unlearned(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert katz.score(spark.createDataFrame([], schema)).count() == 0
    rows = katz.score(spark.createDataFrame([(1, "a b", True), (None, "c", True), (None, "c", True)], schema)).collect()
    assert len(rows) == 3 and all(r["score"] == 0 and r["train_tokens"] == 0 for r in rows)

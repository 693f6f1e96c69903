"""Line dedup, filter audit and Merkle manifest against plain versions, with odd rows in every table."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import filter_audit, line_dedup, merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"
sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common = ["This line stands in very many documents.", "  tHIS LINE stands in very many documents.\t", "ÄRGER über Öl und ein langer Satz", "short", "", "exactly twenty chars", "x" * 19, "漢" * 20, "漢" * 19]
    out = []
    for k in range(160):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randint(0, 60)} of some longer text" for _ in range(rng.randint(0, 9))]
        out.append((k, "\n".join(lines), rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s", None, ""]), rng.choice([None, 7])))
    words = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(90, 260))) + rng.choice(["", " #", " LOUD" * 40]) for _ in range(60)]
    out += [(200 + k, t, "en", "words", len(t)) for k, t in enumerate(words)]
    out += [(300 + k, words[k % 7], "de", "hot", 1) for k in range(30)]
    out += [(400, None, None, None, None), (401, "", "", "", 0), (402, "\n\n", "en", "one", None), (403, "long line of a text " * 5000 + "\n" + "This line stands in very many documents.", "en", "hot", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(n) for n in ("keep", "gone", "grp", "idx", "TEXT", "mask", "path", "toxic")]).repartition(5)


@pytest.fixture(scope="module")
def nameless(spark):
    """Rows without ids, and repeated rows."""
    line = "a line of more than twenty characters"
    return spark.createDataFrame([(None, line, None, None, None)] * 3 + [(5, line, "en", "s", 7)] * 4 + [(6, line + "\nb", "en", "s", 7), (None, None, None, None, None)], SCHEMA)


def plain_lines(rows):
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[lower(line.strip(SPACE))].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(k) >= 20 and len(holders[k]) >= 3 and d != max(holders[k], key=lambda x: (x is not None, x)) for k in (lower(x.strip(SPACE)) for x in lines)]
        out.append((d, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_lines_against_a_plain_version(rows, docs, hot, monkeypatch):
    monkeypatch.setattr(line_dedup.dropped, "__defaults__", (hot,))  # with one frequent key, all others take the shuffled way
    got = sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup.deduplicated(docs).collect())
    assert got == sorted(plain_lines(rows)) and any(n for *_, n in got)


def test_lines_of_rows_without_ids_and_repeated_rows(nameless):
    """Rows without an id are one document, which comes before all others; all rows of the largest id keep the line."""
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.deduplicated(nameless).collect()]
    assert sorted(got, key=str) == sorted([(None, "", 1, 1)] * 3 + [(5, "", 1, 1)] * 4 + [(6, "a line of more than twenty characters\nb", 2, 0), (None, None, 1, 0)], key=str)


def plain_fails(text, again):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(w) < 100 else ""
    out += "B" if 100 * len(set(w)) < 80 * len(w) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    return out + ("D" if re.search("[#$%&*|]", text) else "") + ("E" if again else "")


def plain_audit(rows, labels):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    seen = [(lang or "", plain_fails(t or "", d is not None and d > first[t or ""]), *labels.get(d, (False, False))) for d, t, lang, *_ in rows]
    out = {}
    for part in {x[0] for x in seen}:
        mine = [x for x in seen if x[0] == part]
        total = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                failing = [x for x in mine if f in x[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == f for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in filter_audit.audited(df, labels).collect()}


def test_audit_against_walks_of_all_orders(spark, rows, docs):
    rng = random.Random(3)
    told = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 420, 2)] + [(2, 1, 0), (None, 1, 1)]
    labels = {}
    for d, q, t in told:
        if d is not None:
            good, toxic = labels.get(d, (False, False))
            labels[d] = (good or q == 1, toxic or t == 1)
    got = audited(docs, spark.createDataFrame(told, "doc_id long, quality int, toxic int"))
    assert got == plain_audit(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_rows_without_ids_and_repeated_rows(spark, nameless):
    """No row without an id fails the copy filter; rows of one id don't make each other fail it."""
    rows = [tuple(r) for r in nameless.collect()]
    got = audited(nameless, spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int"))
    assert got == plain_audit(rows, {5: (True, True)})
    assert got["en", "EABCD", 1][:2] == [5, 0]


def test_parity_sums_invert_exactly(spark):
    """Any counts by mask come back, also huge ones and other numbers of filters."""
    rng = random.Random(1)
    counts = {m: rng.choice([0, 1, 7, 10**14]) for m in range(8)}
    df = spark.createDataFrame([("p", False, False, m, n) for m, n in counts.items()], "part string, good boolean, toxic boolean, mask int, n long")
    sums = filter_audit.parity_sums(df, 3).select(filter_audit.inverse(F.col("sums"), 3).alias("c")).first()["c"]
    assert {x["mask"]: x["n"] for x in sums} == counts


def plain_tree(hashes):
    """(root, each leaf's path of (left, right))"""
    paths, groups = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        up, over = [], []
        for at in range(0, len(hashes), 16):
            run = hashes[at : at + 16]
            for k, leaves in enumerate(groups[at : at + 16]):
                for leaf in leaves:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            over.append([x for g in groups[at : at + 16] for x in g])
        hashes, groups = up, over
    return hashes[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda d, t, lang, s, n: sha(field(d), field(s), field(lang), field(n), field(t))
    by = defaultdict(list)
    for r in rows:
        d, t = r[0], r[1]
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by[r[3]].append((d, digest(*r), digest(d, lower(t) if hit and t is not None else t, *r[2:])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0], x[1]))
        trees[s] = plain_tree([x[1] for x in by[s]])
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (d, leaf, changed), path in zip(by[s], trees[s][1]):
            h = changed
            for left, right in path + top:
                h = sha(left, h, right)
            out.append((d, leaf, trees[s][0], root, sha(*[x for p in path + top for x in p]), h, h == root))
    return out


def manifested(df):
    rows = merkle.manifest(df, tampering=merkle.tampered("doc_id", "text"))
    return [tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), "folded_root", F.col("folded_root") == F.col("root")).collect()]


def test_manifest_against_a_plain_tree(rows, docs):
    got = manifested(docs)
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_manifest_with_many_sources_of_one_row_and_rows_of_equal_ids(spark, nameless):
    many = [(k, f"Text {k}", "en", f"source {k:04d}" if k % 3 else "Ä", k) for k in range(300)]
    df = spark.createDataFrame(many, SCHEMA).unionByName(nameless)
    assert sorted(manifested(df), key=str) == sorted(plain_manifest([tuple(r) for r in df.collect()]), key=str)


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.deduplicated(empty).count() == 0 and merkle.manifest(empty).count() == 0
    assert filter_audit.audited(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_walsh_audit", "op13_merkle_manifest"])
def test_queries_are_registered_with_sql(name):
    assert name in queries.queries() and name in queries.oracle_sql()

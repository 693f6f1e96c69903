"""The queries that SQL can't express, against plain Python."""

import hashlib
import math
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models, ordered
from touchline.plans import catalog, models as plans
from touchline.sources.tables import matches, table

SF = "/root/testdata/sf0.001"


def query(spark, name):
    return catalog.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def finished(spark):
    return sorted(matches(spark, SF).where("status = 'finished'").collect(), key=lambda m: (m["day"], m["match_id"]))


def test_elo(spark, finished):
    want = {}
    for competition in {m["competition_id"] for m in finished}:
        ratings, season = {}, None
        mine = [m for m in finished if m["competition_id"] == competition]
        for day in sorted({m["day"] for m in mine}):
            same = [m for m in mine if m["day"] == day]
            if season is not None and same[0]["season"] != season:
                ratings = {t: 1500 + 0.75 * (v - 1500) for t, v in ratings.items()}
            season, moves = same[0]["season"], defaultdict(float)
            for m in same:
                h, a = ratings.get(m["home_team_id"], 1500.0), ratings.get(m["away_team_id"], 1500.0)
                e = 1 / (1 + 10 ** (-(h + 60 - a) / 400))
                s = 1.0 if m["home_score"] > m["away_score"] else 0.5 if m["home_score"] == m["away_score"] else 0.0
                want[m["match_id"]] = (h, a, e)
                moves[m["home_team_id"]] += 20 * (s - e)
                moves[m["away_team_id"]] -= 20 * (s - e)
            for t, v in moves.items():
                ratings[t] = ratings.get(t, 1500.0) + v
    got = {r["match_id"]: (r["home_elo"], r["away_elo"], r["expected"]) for r in query(spark, "ml8_wn23_elo")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_national_strengths(spark, finished):
    got = {(r["competition_id"], r["season"], r["team_id"]): (r["attack"], r["defence"]) for r in query(spark, "ml10_national_strengths")}
    pools = defaultdict(list)
    for m in finished:
        pools[m["competition_id"], m["season"]].append(m)
    n = 0
    for (competition, season), games in pools.items():
        mean = max(sum(m["home_score"] + m["away_score"] for m in games) / (2 * len(games)), 1e-9)
        teams = {t for m in games for t in (m["home_team_id"], m["away_team_id"])}
        attack, defence = dict.fromkeys(teams, 1.0), dict.fromkeys(teams, 1.0)
        sides = [(m["home_team_id"], m["away_team_id"], m["home_score"], m["away_score"]) for m in games] + [(m["away_team_id"], m["home_team_id"], m["away_score"], m["home_score"]) for m in games]
        for _ in range(30):
            attack = {t: (sum(g for x, _, g, _ in sides if x == t) + 3) / (sum(mean * defence[o] for x, o, _, _ in sides if x == t) + 3) for t in teams}
            defence = {t: (sum(g for x, _, _, g in sides if x == t) + 3) / (sum(mean * attack[o] for x, o, _, _ in sides if x == t) + 3) for t in teams}
        for t in teams:
            assert got[competition, season, t] == pytest.approx((attack[t], defence[t]))
            n += 1
    assert n == len(got)


def test_calibrators_are_at_their_optimum(spark):
    """By a plain loss: no small step of any parameter makes it smaller, and season by season the query's losses are those of the fits."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=(1500, 3))
    true = np.exp(z * [0.6, 1.1, 0.8] + [0.3, -0.2, 0.0])
    true /= true.sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=p) for p in true])
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    df = spark.createDataFrame([(*map(float, row), int(k), int(i % 3)) for i, (row, k) in enumerate(zip(p, y))], "home double, draw double, away double, y int, season int").coalesce(2)
    logs = np.log(p)
    unit = np.eye(3)
    designs = {
        "temperature": [logs],
        "bias": [np.tile(unit[k], (len(p), 1)) for k in range(2)],
        "vector": [logs * unit[k] for k in range(3)] + [np.tile(unit[k], (len(p), 1)) for k in range(2)],
    }
    for method, terms in designs.items():
        found, scored = models.calibrated(df, method, steps=10)

        def loss(theta, terms=terms, method=method):
            logits = sum(t * x for t, x in zip(theta, terms)) + (logs if method == "bias" else 0)
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            return -np.log(q[np.arange(len(y)), y]).mean()

        theta = np.array(found[None])
        best = loss(theta)
        for k in range(theta.size):
            for step in (-0.02, 0.02):
                assert loss(theta + step * np.eye(theta.size)[k]) > best
        own = scored.agg(F.avg(-F.log(F.when(F.col("y") == 0, F.col("cal_home")).when(F.col("y") == 1, F.col("cal_draw")).otherwise(F.col("cal_away"))))).first()[0]
        assert own == pytest.approx(best, abs=1e-9)
    by_fold, _ = models.calibrated(df, "temperature", "season", steps=10)
    assert set(by_fold) == {0, 1, 2} and len({round(v[0], 9) for v in by_fold.values()}) == 3
    rows = {r["method"]: r for r in models.calibrator_losses(df, "season").collect()}
    assert set(rows) == {"none", *models.CALIBRATORS} and rows["vector"]["log_loss"] < rows["none"]["log_loss"] and sum(r["chosen"] for r in rows.values()) == 1


def test_calibrators_of_the_forecasts(spark):
    assert {r["method"] for r in query(spark, "ml17_calibrators")} == {"none", *models.CALIBRATORS} and plans.judged(spark, SF).count() > 0


def test_ids(spark):
    customers = {r["c_custkey"]: r for r in table(spark, SF, "customer").collect()}
    got = query(spark, "ing8_ing9_ing11_ids")
    assert len(got) == len(customers)
    for r in got:
        k = customers[r["c_custkey"]]
        assert r["uuid"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, k["c_name"]))
        assert r["hash"] == hashlib.sha256(f"{k['c_name']}|{k['c_mktsegment']}".encode()).hexdigest()
        assert r["slug"] == re.sub("[^a-z0-9]+", "-", k["c_name"].lower()) + "-muller-sohne"


def test_aliases(spark):
    """Titles of pages, by plain greedy matching of the longest alias first."""
    aliases = {("nation", str(r["n_nationkey"])): r["n_nationkey"] for r in table(spark, SF, "nation").collect()} | {("the",): 900, ("the", "and"): 901, ("der",): 902}
    fold = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčćđøłāēīōū", "aaaaaaceeeeiiiinooooouuuuyyszccdolaeiou")
    want = set()
    for r in table(spark, SF, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")).collect():
        words = [w for w in re.split("[^a-z0-9]+", r["title"].lower().replace("ß", "ss").replace("æ", "ae").translate(fold)) if w]
        spans = [(-len(" ".join(words[i:j])), i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in aliases]
        taken = []
        for _, i, j in sorted(spans):
            if all(j <= a or b <= i for a, b in taken):
                taken.append((i, j))
                want.add((r["page_id"], " ".join(words[i:j]), aliases[tuple(words[i:j])]))
    got = {(r["id"], r["alias"], r["entity"]) for r in query(spark, "jn20_longest_alias")}
    assert got == want and want


def test_sums_before_a_value(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v), int(x)) for k, v, x in zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 1), rng.integers(0, 9, 3000))] + [(0, None, 5)]
    df = spark.createDataFrame(rows, "pool int, v double, x int").repartition(5)
    for pool in ((), ("pool",)):
        got = {(*[r[p] for p in pool], r["v"]): (r["n"], r["x"], r["before_n"], r["before_x"]) for r in ordered.before(df, "v", {"x": "x"}, pool=pool).collect()}
        for key, found in got.items():
            mine = [r for r in rows if r[1] is not None and (not pool or r[0] == key[0])]
            same, below = [r for r in mine if r[1] == key[-1]], [r for r in mine if r[1] < key[-1]]
            assert found == (len(same), sum(r[2] for r in same), len(below), sum(r[2] for r in below))
    assert ordered.before(df.limit(0), "v", {"x": "x"}).count() == 0
    assert math.isclose(models.area_under_curve(df.where("v is not null"), F.col("v"), F.col("x") > 4).first()["auc"], np.mean([(a > b) + 0.5 * (a == b) for a in [r[1] for r in rows[:-1] if r[2] > 4] for b in [r[1] for r in rows[:-1] if r[2] <= 4]]))

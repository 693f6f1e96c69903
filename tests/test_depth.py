"""Literal fixtures: play-by-play, registries, semi-structured values, pages, ranks, load, licences, order rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import rules
from touchline.operators import assembly, calibration, decisions, desk, gates, identity, models, ordered, profiles, variants
from touchline.operators import ledger as g
from touchline.operators import text as texts
from touchline.sources import playbyplay, registry

c = F.col


def test_plays_are_typed_ordered_and_placed(spark):
    ref = lambda kind, n: {"$ref": f"http://x/v2/{kind}/{n}?lang=en&region=us"}
    items = [
        {"id": "30", "type": {"text": "Goal - Header"}, "period": {"number": 2}, "clock": {"value": 3000}, "team": ref("teams", 7), "participants": [{"order": 2, "athlete": ref("athletes", 5)}, {"order": 1, "athlete": ref("athletes", 4)}], "fieldPositionX": 90, "fieldPositionY": 25, "fieldPosition2X": 100, "fieldPosition2Y": 50, "scoringPlay": True, "contactType": {"text": "Head"}},
        {"id": "20", "type": {"text": "Pass"}, "period": {"number": 1}, "clock": {"value": 61}, "team": ref("teams", 8), "fieldPositionX": 50, "fieldPositionY": 0, "fieldPosition2X": 60, "fieldPosition2Y": 100},
        {"id": "9", "type": {"text": "Pass"}, "period": {"number": 1}, "clock": {"value": 61}, "fieldPositionX": 101, "fieldPositionY": 0},
        {"id": "21", "type": {"text": "Goal - Overhead"}, "period": {"number": 1}, "clock": {"value": 100}, "ownGoal": True, "fieldPositionX": 0, "fieldPositionY": 0},
        {"id": "22", "type": {"text": "Half Time"}, "period": {"number": 1}, "clock": {"value": 2700}},
        {"id": "23", "type": {"text": "Bicycle Trick!"}, "period": {"number": 1}, "clock": {"value": 2701}, "redCard": True},
        {"id": "24", "type": {"text": "Foul"}, "valid": False},
    ]
    small = [{"id": str(k), "type": {"text": "Shot On Target"}, "period": {"number": 1}, "clock": {"value": k}, "fieldPositionX": 0.2 + k / 10, "fieldPositionY": 0.5} for k in range(5)]
    few = small[:4]
    df = spark.createDataFrame([(1, json.dumps({"items": items})), (2, json.dumps({"items": small})), (3, json.dumps({"items": few})), (4, '{"items": ['), (5, json.dumps({"items": []}))], "match_id long, body string")
    rows = playbyplay.play_rows(df).orderBy("match_id", "sequence").collect()
    one = [r for r in rows if r["match_id"] == 1]
    assert [r["source_event_id"] for r in one] == ["9", "20", "21", "22", "23", "30"]
    out, passed, own, half, odd, goal = one
    assert (out["x_m"], out["source_x"], out["coordinates"]) == (None, 101.0, "percent")  # out of range: never mapped
    assert (passed["x_m"], passed["y_m"], passed["end_x_m"], passed["end_y_m"], passed["minute"], passed["team"], passed["player"]) == (52.5, 68.0, 63.0, 0.0, 2, "8", None)
    assert (own["event_type"], own["subtype"], own["outcome"], own["is_goal"], own["is_own_goal"]) == ("touch", "own_goal", "goal", False, True)
    assert (half["event_type"], half["subtype"]) == ("interruption", "espn_half_time")
    assert (odd["event_type"], odd["subtype"], odd["card"], odd["clock_seconds"]) == ("unmapped", "espn_bicycle_trick", "red", 2701.0)
    assert (goal["is_goal"], goal["player"], goal["team"], goal["body_part"], goal["x_m"], goal["y_m"], goal["end_x_m"], goal["clock_seconds"], goal["period"]) == (True, "4", "7", "head", 94.5, 51.0, None, 300.0, "2H")
    assert all(r["x_m"] is None and r["source_x"] is not None and r["coordinates"] == "unit" for r in rows if r["match_id"] == 2)
    assert all(r["x_m"] is not None and r["coordinates"] == "percent" for r in rows if r["match_id"] == 3)  # too few to tell
    assert {r["match_id"] for r in rows} == {1, 2, 3}


def test_registry_reports_what_it_does_not_take(spark, tmp_path):
    entry = lambda i, **more: {"provider": "p", "external_id": i, "same_as": {"provider": "p", "external_id": "9"}, "reviewer": "r", "evidence": ["e"], **more}
    documents = {
        "a.json": json.dumps({"registry_version": "2026-01.1", "note": "n", "entries": [entry("1"), entry("2"), entry("3", evidence=[]), entry("4", same_as={"provider": "p"})]}, indent=2),
        "b.json": json.dumps({"registry_version": "2026-02.1", "entries": [entry("2", reviewer="later"), {"provider": {"x": 1}, "external_id": "5"}, entry("6"), entry("6"), entry("8", evidence="a text")]}, indent=2),
        "c.json": '{"registry_version": "2026-03.1", "entries": [',
        "d.json": json.dumps({"entries": [entry("7")]}),
        "e.json": json.dumps({"registry_version": "2026-04.1"}),
    }
    for name, text in documents.items():
        (tmp_path / name).write_text(text)
    loaded = registry.load(spark, f"file://{tmp_path}")
    got = {(r["file"], r["place"]): r["problem"] for r in loaded.collect()}
    assert got == {
        ("a.json", 0): None, ("a.json", 1): "duplicate", ("a.json", 2): "lacks evidence", ("a.json", 3): "lacks same_as", ("b.json", 0): None, ("b.json", 1): "misfit", ("b.json", 2): None, ("b.json", 3): "duplicate", ("b.json", 4): "misfit",
        ("c.json", None): "broken document", ("d.json", None): "no version", ("e.json", None): "no entries",
    }
    taken = registry.accepted(loaded).collect()
    assert sorted((r["external_id"], r["reviewer"]) for r in taken) == [("1", "r"), ("2", "later"), ("6", "r")]


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("1", "1.0", True), ("1", '"1"', True), ('"01"', '"1"', True), ("1", "true", False), ("null", None, True), ("null", "0", False), (None, '""', False),
        ('{"a": 1, "b": [1, {"c": null}]}', '{"b": [1, {"c": null}], "a": 1}', True), ("[1, 2]", "[2, 1]", False), ('{"a": 1}', '{"a": 2}', False), ('{"a": 1}', '"x"', False),
        ('"2017-08-18T18:30:00+00:00"', '"2017-08-18T20:30:00+02:00"', True), ('"2017-08-18T18:30:00Z"', '"2017-08-18"', True), ('"2017-08-18T18:30:00Z"', '"2017-08-19"', False), ('"x"', '"X"', False),
    ],
)
def test_values_are_the_same_whatever_their_types_and_order(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(variants.parsed(c("a")).alias("a"), variants.parsed(c("b")).alias("b"))
    assert df.select(variants.same(c("a"), c("b")).alias("x"), variants.same(c("b"), c("a")).alias("y")).first() == (equal, equal)


def test_names_are_found_at_any_depth(spark):
    deep = '{"x":' * 20 + '{"closing_price": 1}' + "}" * 20
    rows = [(1, '{"a": {"odds": 1}, "text": "the odds: {\\"odds\\": 1}"}'), (2, '[[{"k": [{"bookmakerName": null}]}]]'), (3, "5"), (4, "null"), (5, deep), (6, None), (7, '{"odd": {"o.dds": 1}}')]
    df = spark.createDataFrame(rows, "id long, j string").select("id", variants.parsed(c("j")).alias("v"))
    got = {(r["key"], r["path"]) for r in variants.denied(df, "id", "v").collect()}
    assert got == {(1, "$.a.odds"), (2, "$[0][0].k[0].bookmakerName"), (5, "$" + ".x" * 20 + ".closing_price")}
    with pytest.raises(ValueError):
        variants.leaves(df, "id", "v", deepest=5)


def test_all_pages_give_each_row_once_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.0, 2.0, 2.5]), k) for k in range(503)]
    pages = ordered.Pages(spark.createDataFrame(rows, "v double, id long").repartition(6), ["v", "id"], ranges=7)
    want = [r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))]
    assert [r["id"] for r in pages.placed().orderBy("place").collect()] == want
    assert sum(([r["id"] for r in pages.page(n, 100).collect()] for n in range(7)), []) == want
    key, walked = None, []
    while batch := pages.after(key, 60).collect():
        walked += [r["id"] for r in batch]
        key = (batch[-1]["v"], batch[-1]["id"])
    assert walked == want
    reads = pages.page(2, 100)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in reads and "PartitionFilters" in reads  # no global sort, some folders only


@pytest.mark.parametrize("few", [5, 40, 100_000])
def test_ranks_are_exact_whatever_the_sketch_says(spark, few):
    rng = random.Random(7)
    rows = [("flat", float(k)) for k in range(3000)] + [("two", float(k % 2)) for k in range(2000)] + [("heavy", 5.0 if k % 10 else rng.gauss(5, 9)) for k in range(2500)] + [("one", 1.5), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pool string, v double").repartition(4)
    ranks = {"low": F.lit(0), "third": F.floor(c("n") / 3.0), "half": F.floor((c("n") - 1) / 2), "most": c("n") - 1}
    got = {r["pool"]: (r["low"], r["third"], r["half"], r["most"]) for r in ordered.at_ranks(df, "v", ranks, "pool", few=few).collect()}
    for pool in ("flat", "two", "heavy", "one"):
        v = sorted(x for p, x in rows if p == pool)
        n = len(v)
        assert got[pool] == (v[0], v[n // 3], v[(n - 1) // 2], v[-1])
    assert set(got) == {"flat", "two", "heavy", "one"}


def test_load_of_a_team_by_hand(spark):
    """Matches of team 1 on days 80, 98, 100 (away, extra time), 101, then the match of day 104; the next one is on day 106."""
    played = [(10, 1, 80, 1, 2), (11, 2, 98, 1, 3), (12, 2, 100, 4, 1), (13, 1, 101, 1, 5)]
    rows = [(m, comp, day, h, a, "finished", "extra_time" if m == 12 else "regular") for m, comp, day, h, a in played] + [(14, 1, 104, 1, 6, "scheduled", "regular"), (15, 1, 106, 7, 1, "scheduled", "regular")]
    df = spark.createDataFrame(rows, "match_id long, competition_id int, day long, home_team_id int, away_team_id int, status string, duration string")
    r = {(x["match_id"], x["team_id"]): x for x in profiles.team_load(df).collect()}[14, 1]
    assert (r["matches_7"], r["matches_14"], r["matches_21"], r["short_rest"], r["extra_time"], r["days_since_last"], r["last_match_id"]) == (3, 3, 3, 2, 1, 3, 13)
    assert (r["away_share"], r["switches"], r["next_match_id"], r["rest_before_next"]) == (0.25, 2, 14, 3)
    # 0.35 * 3/5, 0.25 * 2/3, 0.25 * (6 - 3)/4, 0.1 * 0.25, 0.05 * 2/3
    assert [r[f"from_{k}"] for k in profiles.FATIGUE] == [21.0, 16.67, 18.75, 2.5, 3.33] and r["load"] == 62


@pytest.mark.parametrize(
    "name, code, url, author, non_free, crest, verdict",
    [
        ("CC BY-SA 4.0", "cc-by-sa-4.0", "u", "A", False, False, "approved"), ("CC BY-NC 4.0", "cc-by-nc-4.0", "u", "A", False, False, "restricted"), ("CC BY-ND 2.0", None, "u", "A", False, False, "restricted"),
        ("CC BY 2.0", "cc-by-2.0", "u", "", False, False, "review_required"), ("CC BY 2.0", "cc-by-2.0", None, "A", False, False, "review_required"), ("CC0", "cc0", None, None, False, False, "approved"), ("CC0", "cc0", None, None, False, True, "review_required"),
        ("Public domain", "pd", None, None, False, True, "approved"), ("CC0", "cc0", None, None, True, False, "rejected"), ("GFDL", "gfdl", "u", "A", False, False, "review_required"), (None, None, None, None, None, None, "review_required"),
    ],
)
def test_licences(spark, name, code, url, author, non_free, crest, verdict):
    df = spark.createDataFrame([(name, code, url, author, non_free, bool(crest))], "name string, code string, url string, author string, non_free boolean, crest boolean")
    assert df.select(rules.licence(*[c(x) for x in df.columns])).first()[0] == verdict


def test_events_and_outcomes_by_their_codes(spark):
    rows = [(8, 85, [1801]), (10, 100, [101, 1801]), (10, 100, [1802, 2101]), (1, 10, [703]), (3, 35, [1802]), (6, None, []), (99, 99, [1801]), (1, 11, [1801])]
    df = spark.createDataFrame(rows, "e int, s int, tags array<int>").withColumn("k", rules.event_kind(c("e"), c("s")))
    got = [tuple(r) for r in df.select("k.type", "k.subtype", "k.set_piece", rules.outcome(c("k.type"), c("tags"))).collect()]
    assert got == [
        ("pass", "simple", None, "success"), ("shot", "open_play", None, "goal"), ("shot", "open_play", None, "blocked"), ("duel", "aerial", None, "won"), ("shot", "penalty", "penalty", "off_target"),
        ("offside", "offside", None, None), (None, None, None, "success"), ("duel", "ground_attacking", None, None),
    ]


def test_order_is_by_day_where_ids_run_against_time(spark):
    """Match 9 was first, match 1 last."""
    e = spark.createDataFrame([(9, 1, 1, 7, 1, 70), (5, 2, 1, 7, 2, 70), (5, 2, 2, 8, 1, 70), (1, 3, 1, 8, 3, 70)], "match_id long, day long, sequence int, player_id long, team_id int, home_team_id int")
    assert {r["player_id"]: r["spells"] for r in profiles.collapsed_runs(e).collect()} == {7: 2, 8: 2}
    same = e.withColumn("team_id", F.lit(1))
    assert [(r["match_id"], r["shared"], r["used"]) for r in profiles.eleven_overlap(same).orderBy("day").collect()] == [(5, 1, 2), (1, 1, 1)]


def test_minutes_end_with_a_red_card_only(spark):
    rows = [(1, 1, 5, 10, "foul", None, False), (1, 2, 6, 20, "foul", "yellow", True), (1, 3, 5, 60, "foul", "red", False), (1, 4, 7, 30, "pass", None, False), (1, 5, 7, 70, "foul", "red", False)]
    e = spark.createDataFrame([(m, s, p, 1, mi, k, card, own) for m, s, p, mi, k, card, own in rows], "match_id long, sequence int, player_id long, team_id int, minute int, event_type string, card string, is_own_goal boolean")
    assert {r["player_id"]: r["minutes"] for r in g.minutes(e).collect()} == {5: 60, 6: 90, 7: 40}


def test_a_look_ahead_is_found(spark):
    rows = spark.createDataFrame([(k, 1, k // 2, float(k % 5)) for k in range(200)], "match_id long, team_id int, day long, gf double")
    w = lambda a, b: __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("day").rangeBetween(a, b)
    back = lambda x: x.withColumn("v", F.avg("gf").over(w(-9, -1)))
    ahead = lambda x: x.withColumn("v", F.avg("gf").over(w(-9, 3)))
    found = [models.truncation_differences(b, rows, ["match_id"], ["v"], 50).first()["different"] for b in (back, ahead)]
    assert found[0] == 0 and 0 < found[1] <= 6


def test_a_season_is_held_on_its_own(spark):
    teams = range(4)
    good = [(10 * a + b, 1, 2001, 100 + 10 * a + b, a, b, "finished", 1, 0) for a in teams for b in teams if a != b]
    bad = [(500 + m, 2, 2001, d, a + 50, b + 50, s, 99 if m == 1 else h, aw) for m, _, _, d, a, b, s, h, aw in good] + [(501, 2, 2001, 999, 50, 51, "finished", 1, 1)]
    df = spark.createDataFrame(good + bad, "match_id long, competition_id int, season int, day long, home_team_id int, away_team_id int, status string, home_score int, away_score int")
    df = df.withColumn("kickoff_at", F.timestamp_seconds(F.datediff(F.make_date("season", F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")) * 86400)).withColumn("day", F.datediff("kickoff_at", F.lit("1970-01-01").cast("date")).cast("long"))
    failed = {(r["competition_id"], r["check"]) for r in identity.acceptance(df).where("not passed").collect()}
    assert failed == {(2, "scores in range"), (2, "unique ids"), (2, "one listing per pair and day"), (2, "one match per pair"), (2, "balanced")}


def test_each_order_rule_fails_once(spark):
    rng = random.Random(9)
    raw = []
    for _ in range(400):
        p = sorted((rng.random() + 0.1 for _ in range(3)), reverse=rng.random() < 0.7)
        raw.append([x / sum(p) for x in p])
    y = [rng.choices(range(3), p)[0] for p in raw]

    def kept(change):
        rows = [(k, y[k], *raw[k], *change(k, raw[k])) for k in range(400)]
        df = spark.createDataFrame(rows, "match_id long, y int, raw_home double, raw_draw double, raw_away double, cal_home double, cal_draw double, cal_away double")
        return calibration.order_kept(df).first().asDict()

    same = kept(lambda k, p: p)
    assert (same["k5"], same["k6"], same["changes"], same["least_spearman"], same["most_d_auc"]) == (True, True, 0, 1.0, 0.0)
    swapped = kept(lambda k, p: p if k % 20 else [p[2], p[1], p[0]])  # favourites of a twentieth change
    assert not swapped["k6"] and swapped["changes"] > 8
    shuffled = kept(lambda k, p: [p[0], raw[(k * 7) % 400][1], p[2]])
    assert not shuffled["k5"] and shuffled["least_spearman"] < 0.5


GOOD = {"d_log_loss": -0.001, "d_brier": 0.0, "d_ece": -0.01, "lowest": 0.05, "highest": 0.9, "draw_low": 0.1, "draw_high": 0.4, "shift": 0.05}


@pytest.mark.parametrize(
    "rule, change, k5, k6, season",
    [
        ("", {}, True, True, 0.001), ("K1", {"d_log_loss": 0.0}, True, True, 0.001), ("K2", {"d_brier": 0.001}, True, True, 0.001), ("K3", {"d_ece": 0.0}, True, True, 0.001), ("K4", {}, True, True, 0.003),
        ("K5", {}, False, True, 0.001), ("K6", {}, True, False, 0.001), ("K6", {}, True, None, 0.001), ("K7", {"highest": 0.96}, True, True, 0.001), ("K7", {"draw_low": 0.04}, True, True, 0.001), ("K7", {"draw_high": 0.46}, True, True, 0.001),
    ],
)
def test_each_rule_of_a_calibrator_fails_once(spark, rule, change, k5, k6, season):
    measures = GOOD | change
    raw = spark.createDataFrame([("m", *measures.values())], "method string, " + ", ".join(f"{k} double" for k in measures))
    seasons = spark.createDataFrame([("m", 1, season), ("m", 2, season)], "method string, season int, d_log_loss double")
    order = spark.createDataFrame([("m", k5, k6)], "method string, k5 boolean, k6 boolean")
    r = desk.keep_calibrator(raw, seasons, order).first()
    assert (r["failed"], r["kept"]) == (rule, rule == "")


HELD = [("m", 1, 0.9, True, 0.5)] * 30 + [("m", 2, 0.8, True, 0.5)] * 24 + [("m", 2, 0.8, False, 0.5)] * 6


@pytest.mark.parametrize(
    "rows, failed",
    [
        (HELD, ""), ([(*r[:4], 0.93 if r[3] else 0.05) for r in HELD], "H0,H3"), ([(*r[:2], 0.99, *r[3:]) for r in HELD], "H1,H5"), ([("m", 1, 0.7, k % 2 == 0, 0.3) for k in range(20)], "H0,H1,H2,H5"),
        ([("m", 1, 0.9, k >= 3, 0.85) for k in range(30)], "H3"), (HELD[:19], "H4"), (HELD[:30] * 3 + [("m", 2, 0.9, k < 7, 0.5) for k in range(10)], "H5"), ([("m", 1, 0.4, False, 0.5)] * 30, "H1,H2,H3,H4"),
    ],
)
def test_each_holdout_rule_fails_once(spark, rows, failed):
    df = spark.createDataFrame(rows, "market string, season int, probability double, hit boolean, base double")
    r = decisions.holdout_rules(df, {"m": 0.6}).first()
    assert (r["failed"], r["active"]) == (failed, failed == "")


@pytest.mark.parametrize(
    "text, kind, profile, verified, zones, possession, failed",
    [
        ("A draw in the rain.", "match_recap", "mls", False, [], False, ""), ("They will win the cup", "match_preview", "mls", False, [], False, "preview_prediction"), ("They will win the cup", "match_recap", "mls", False, [], False, ""),
        ("a Relegation fight", "match_recap", "mls", False, [], False, "mls_relegation"), ("a relegation fight", "match_recap", "domestic_european_league", False, [], False, ""), ("they go down", "match_recap", "domestic_league_relegation_playoff", False, [], False, "relegation_claim_unsupported"),
        ("Eastern Conference leaders", "match_recap", "mls", False, [], False, "mls_conference_claim"), ("Eastern Conference leaders", "match_recap", "mls", True, [], False, ""), ("the top-four", "match_recap", "ucl_league_phase", True, [], False, "ucl_top_four"),
        ("promoted to League A", "match_recap", "nations_league", True, ["Relegation"], False, "nl_promotion_claim"), ("promoted to League A", "match_recap", "nations_league", True, ["Promotion to A"], False, ""), ("promoted", "match_recap", "nations_league", False, ["Promotion"], False, "nl_promotion_claim"),
        ("top of their group", "match_recap", "nations_league", True, None, False, ""), ("60 % possession", "match_recap", None, None, None, True, ""), ("60 % possession", "match_recap", None, None, None, False, "unsupported_possession"), (None, None, None, None, None, None, ""),
    ],
)
def test_gates_by_kind_and_profile(spark, text, kind, profile, verified, zones, possession, failed):
    df = spark.createDataFrame([(1, text, kind, profile, verified, zones, possession)], "id long, text string, kind string, profile string, verified boolean, zones array<string>, possession boolean")
    assert gates.gated(df).first() == (1, failed, failed == "")


def test_videos_of_an_article(spark):
    links = spark.createDataFrame([(1, v, s) for v, s in ((10, 90), (11, 80), (12, 80), (13, 80), (14, 95), (15, 99), (16, 70))], "article_id long, video_id long, score int")
    videos = spark.createDataFrame([(10, "a", "other", 50, None, None, None), (11, "a", "highlights", 90, True, False, False), (12, "a", "highlights", 300, True, False, False), (13, "a", "highlights", 200, True, False, False), (14, "x", "goals", 10, True, False, False), (15, "a", "goals", 10, False, False, False), (16, "a", "goals", 10, True, True, False)],
        "video_id long, channel string, type string, seconds int, embeddable boolean, short boolean, live boolean")
    got = desk.article_videos(links, videos, spark.createDataFrame([("a",)], "channel string"), k=3).orderBy("place").collect()
    assert [r["video_id"] for r in got] == [10, 13, 12]  # unknown channel, not to be embedded and short ones left out; the shorter full cut first


def test_table_before_each_day(spark):
    """Two matches of one day don't see each other; the table after one of them has only its own result."""
    m = [(1, 1, 2, 2, 0), (1, 3, 4, 1, 1), (2, 1, 3, 0, 1), (2, 2, 4, 0, 0)]
    rows = [(1, 2000, d, h, a, True, x, y) for d, h, a, x, y in m] + [(1, 2000, d, a, h, False, y, x) for d, h, a, x, y in m]
    df = spark.createDataFrame([(k, *r, 3 if r[6] > r[7] else int(r[6] == r[7])) for k, r in enumerate(rows)], "match_id long, competition_id int, season int, day long, team_id int, opponent_id int, is_home boolean, gf int, ga int, points int")
    before = {r["day"]: [(x["team"], -x["p"], -x["d"], x["n"]) for x in r["before"]] for r in texts.tables_before(df).collect()}
    assert before == {1: [], 2: [(1, 3, 2, 1), (3, 1, 0, 1), (4, 1, 0, 1), (2, 0, -2, 1)]}


def test_season_inputs_take_the_richest_family_before_the_day(spark):
    m = spark.createDataFrame([(1, 1, 2000, 5, "finished"), (2, 1, 2000, 6, "finished"), (3, 1, 2000, 9, "finished"), (4, 1, 2000, 4, "scheduled"), (5, 1, 2000, 3, "finished")], "match_id long, competition_id int, season int, day long, status string")
    e = [(1, "espn", "shot", True, False, None), (1, "wyscout_figshare", "shot", False, False, None), (1, "wyscout_figshare", "foul", False, False, "red"), (1, "espn", "foul", False, False, "yellow"), (2, "openligadb", "touch", False, True, None), (3, "espn", "shot", True, False, None), (5, "espn", "foul", False, False, "yellow"), (5, "espn", "pass", False, False, None)]
    events = spark.createDataFrame([(a, 1, b, k, g_, o, x) for a, b, k, g_, o, x in e], "match_id long, player_id long, source_family string, event_type string, is_goal boolean, is_own_goal boolean, card string")
    r = assembly.season_inputs(m, events, 9).first().asDict()
    # Of match 1 the richest family alone: its shot without the goal, its card; match 5 has a card only; match 3 is of the day itself.
    assert r == {"competition_id": 1, "season": 2000, "matches": 3, "first_day": 3, "cutoff": 6, "with_events": 3, "goals": 0, "own_goals": 1, "shots": 1, "cards": 2}

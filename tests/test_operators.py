"""Small fixtures with literal results, guards, streams and idempotency."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import exprs as x
from touchline.operators import identity, ingest, models, quality, ratings, results, text
from touchline.sources import captures
from touchline.streaming import live


def matches(spark, rows):
    df = spark.createDataFrame(rows, "match_id long, day long, home_team_id int, away_team_id int, home_score int, away_score int")
    return df.select("*", F.lit(1).alias("competition_id"), F.lit(2000).alias("season"), F.lit("finished").alias("status"))


def test_table_ties_end_with_goals_then_id(spark):
    rows = [(1, 1, 1, 2, 1, 0), (2, 1, 3, 4, 2, 1), (3, 2, 1, 3, 0, 0), (4, 2, 2, 4, 3, 3), (5, 3, 1, 4, 0, 1), (6, 3, 2, 3, 1, 0)]
    table = results.league_table(results.team_match(matches(spark, rows))).orderBy("position").collect()
    assert [(r["team_id"], r["points"], r["gd"], r["gf"]) for r in table] == [(4, 4, 0, 5), (2, 4, 0, 4), (3, 4, 0, 2), (1, 4, 0, 1)]


def test_matches_of_one_day_do_not_see_each_other(spark):
    rows = [(1, 10, 1, 2, 5, 0), (2, 20, 1, 3, 4, 0), (3, 20, 1, 2, 0, 0), (4, 30, 1, 2, 1, 1)]
    team = results.team_match(matches(spark, rows))
    known = {(r["match_id"], r["team_id"]): r for r in models.decayed_strengths(team).collect()}
    assert known[2, 1]["attack"] == known[3, 1]["attack"] and (1, 1) not in known
    # The future doesn't matter.
    cut = {(r["match_id"], r["team_id"]): r["attack"] for r in models.decayed_strengths(team.where("day <= 20")).collect()}
    assert all(known[k]["attack"] == v for k, v in cut.items())
    rated = {r["match_id"]: r for r in ratings.elo(matches(spark, rows)).collect()}
    assert rated[2]["home_elo"] == rated[3]["home_elo"] != rated[1]["home_elo"]


def test_markets_add_up(spark):
    df = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.2, 3.0), (3, 0.0, 0.0)], "match_id long, home_rate double, away_rate double")
    for r in models.markets(df).collect():
        assert r["home"] + r["draw"] + r["away"] == pytest.approx(1)
    assert {r["match_id"]: r["draw"] for r in models.markets(df).collect()}[3] == 1


def test_upsert_twice_writes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "id long, name string, v double")
    new = spark.createDataFrame([(1, "a", None), (2, "c", 2.0), (3, None, 1.0)], "id long, name string, v double")
    diff = ingest.diff_upsert(old, new, ["id"], ["name", "v"])
    assert [diff.inserted.count(), diff.updated.count(), diff.unchanged.count()] == [1, 1, 1]
    assert [tuple(r) for r in diff.changes.collect()] == [(2, "name", "b", "c")]
    again = ingest.diff_upsert(ingest.merged(old, new, ["id"]), new, ["id"], ["name", "v"])
    assert again.inserted.isEmpty() and again.updated.isEmpty()
    with pytest.raises(ValueError):
        ingest.require_unique(new.unionByName(new), "id")


def test_fixture_proof(spark):
    ours = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 1, 3), (5, 2, 1), (6, 3, 2)], "day long, home int, away int")
    theirs = ours.select((F.col("day")).alias("day"), (F.col("home") + 10).alias("home"), (F.col("away") + 10).alias("away"))
    proven = {r["provider_team"]: r["canonical_team"] for r in identity.fixture_proof(ours, theirs, reach=0).collect()}
    assert proven == {11: 1, 12: 2, 13: 3}
    wrong = theirs.withColumn("day", F.when(F.col("day") == 6, 60).otherwise(F.col("day")))
    verdicts = {r["provider_team"]: r["verdict"] for r in identity.fixture_proof(ours, wrong, reach=0).collect()}
    assert verdicts == {11: "proven", 12: "contradicted", 13: "contradicted"}


def test_rounding_and_places(spark):
    df = spark.createDataFrame([(1.005, 101.0), (2.5, 50.0), (-1.5, -1.0)], "a double, b double")
    got = df.select(x.half_up(F.col("a"), 2).alias("a"), x.to_pitch(F.col("b"), F.col("b"), 100.0, 100.0)[0].alias("x")).collect()
    assert [(r["a"], r["x"]) for r in got] == [(1.0, None), (2.5, 52.5), (-1.5, None)]
    assert df.limit(1).select(x.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.lit("www.example.com")).alias("u")).first()["u"] == "2ed6657d-e927-568b-95e1-2665a8aea6a2"
    assert df.limit(1).select(x.slug(F.lit(" Müller & Søn ")).alias("s")).first()["s"] == "muller-son"
    assert df.limit(1).select(x.shown_minute(F.lit(47), F.lit(45)).alias("m")).first()["m"] == "45+2'"


def test_grounding_and_leaks(spark):
    articles = spark.createDataFrame([(1, "Half-time 2-1, final 3-1"), (2, "A 7 here")], "id long, text string")
    packets = spark.createDataFrame([(1, "2 1 3"), (2, "8")], "id long, text string")
    assert {r["id"]: r["passes"] for r in text.ungrounded_numbers(articles, packets).collect()} == {1: True, 2: False}
    bad = spark.createDataFrame([(1, (2.0,))], "id long, inputs struct<home_odds: double>")
    with pytest.raises(ValueError):
        quality.require_no_leaks(bad)
    assert quality.require_no_leaks(articles) is articles


def test_captures(spark, tmp_path):
    event = '[{"id": 2, "matchId": 7, "matchPeriod": "2H", "eventSec": 1.0, "teamId": 1, "playerId": 5, "tags": [{"id": 101}], "positions": [{"x": 50, "y": 50}]}, {"id": 1, "matchId": 7, "matchPeriod": "1H", "eventSec": 900.5, "teamId": 2, "playerId": 6, "tags": [{"id": 1801}], "positions": []}]'
    got = captures.sequenced_events(spark.createDataFrame([(event,), ("not json",)], "body string")).orderBy("sequence").collect()
    assert [(r["id"], r["is_goal"], r["outcome"], r["x_m"]) for r in got] == [(1, False, "success", None), (2, True, "fail", 52.5)]
    side = '{"wyId": 9, "status": "Played", "teamsData": {"1": {"side": "home", "teamId": 1, "score": 2, "formation": {"lineup": [{"playerId": 3}]}}, "2": {"side": "away", "teamId": 2, "score": 0, "formation": {"substitutions": [{"playerIn": 4, "playerOut": 5, "minute": 60}]}}}}'
    assert {(r["side"], r["score"], r["n_substitutions"]) for r in captures.match_sides(spark.createDataFrame([(side,)], "body string")).collect()} == {("home", 2, 0), ("away", 0, 1)}
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame([("http://a/?b=2&a=1#x", "one"), ("http://a/", "one"), ("http://b/", "two")], "url string, content string")
    assert {r["url"] for r in captures.archive(pages, path).collect()} == {"http://a/?a=1&b=2", "http://a/", "http://b/"}
    captures.archive(pages, path)
    assert spark.read.parquet(path).count() == 2
    assert spark.range(1).select(captures.escapes_decoded(F.lit("M\\u00fcller")).alias("n")).first()["n"] == "Müller"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = live.stream_of(spark, f"{tmp_path}/in")
    live.run_once(live.deduplicated(stream, "60 days"), f"{tmp_path}/dedup", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/dedup").count() == events.count()
    live.run_once(live.live_state(stream), f"{tmp_path}/state", f"{tmp_path}/c2", "update")
    states = spark.read.parquet(f"{tmp_path}/state")
    assert states.where("status = 'live'").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] <= events.count()
    live.run_once(live.tumbling(stream, late="60 days"), f"{tmp_path}/windows", f"{tmp_path}/c3", "update")
    last = spark.read.parquet(f"{tmp_path}/windows").groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert last == events.count()


def test_every_named_entity_is_found_longest_alias_first(spark):
    titles = spark.createDataFrame([(1, "Houston Dynamo vs. Sporting Kansas City | Highlights"), (2, "Sporting vs. Porto"), (3, "Borussia Mönchengladbach II: kansas city sporting kansas"), (4, ""), (5, None)], "id int, title string")
    aliases = spark.createDataFrame([("houston dynamo", 1), ("sporting kansas city", 2), ("sporting", 3), ("porto", 4), ("Borussia Mönchengladbach II", 5), ("borussia", 6), ("city", 7)], "alias string, entity int")
    got = sorted((r["id"], r["entity"]) for r in text.longest_alias(titles, aliases).collect())
    assert got == [(1, 1), (1, 2), (2, 3), (2, 4), (3, 3), (3, 5), (3, 7)]
    assert text.longest_alias(titles, aliases.limit(0)).count() == 0


def test_profiles_wins_and_feeders_leave_the_day_out(spark):
    """Two matches of day 20: neither counts in the other's inputs."""
    from touchline.operators import profiles

    rows = [(1, 10, 1, 2, 5, 0), (2, 20, 1, 3, 4, 0), (3, 20, 1, 2, 2, 0), (4, 30, 1, 2, 1, 1)]
    team = results.team_match(matches(spark, rows))
    recent = {(r["match_id"], r["team_id"]): r for r in profiles.recent_profile(team).collect()}
    assert recent[2, 1]["n"] == recent[3, 1]["n"] == 1 and recent[2, 1]["attack"] == recent[3, 1]["attack"] == 5.0
    assert recent[4, 1]["n"] == 3 and recent[4, 1]["attack"] == pytest.approx(11 / 3) and recent[1, 1]["attack"] is None
    wins = {(r["match_id"], r["team_id"]): r["last_win"] for r in identity.latest_before(team).collect()}
    assert wins[2, 1] == wins[3, 1] == 1 and wins[4, 1] == 3 and wins[1, 1] is None
    cup = spark.createDataFrame([(1, 10, 1, 2, 1), (2, 10, 3, 4, 3), (3, 20, 1, 5, 1), (4, 20, 1, 3, 3)], "match_id long, day long, home_team_id int, away_team_id int, winner int")
    assert [tuple(r) for r in identity.feeders(cup).collect()] == [(4, 1, 2)]
    eight = [(k, k, 1, 2, k, 0) for k in range(1, 13)]
    last = {r["match_id"]: r for r in profiles.recent_profile(results.team_match(matches(spark, eight))).where("team_id = 1").collect()}
    assert last[12]["n"] == 8 and last[12]["attack"] == sum(range(4, 12)) / 8


def test_related_names_everyone(spark):
    """An entity that more than 50 articles name still relates them."""
    from touchline.operators import text as words

    articles = spark.createDataFrame([(k, "d", k) for k in range(80)], "id int, desk string, day int")
    entities = spark.createDataFrame([(k, "Person", 1) for k in range(80)], "id int, type string, entity int")
    got = {r["id"]: [] for r in articles.collect()}
    for r in words.related(articles, entities).collect():
        got[r["id"]].append((r["place"], r["other"], r["score"]))
    assert all(len(v) == 4 for v in got.values()) and sorted(got[79])[0] == (1, 78, 60 + 4 + 12)


def test_guards_refuse(spark):
    from touchline.operators import decisions

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, state string")
    with pytest.raises(ValueError):
        decisions.conditional_update(df, None, {"state": F.lit("x")})
    with pytest.raises(ValueError):
        decisions.conditional_update(df, F.col("id") > 0, {"other": F.lit("x")})
    assert sorted((r["id"], r["state"], r["updated"]) for r in decisions.conditional_update(df, F.col("state") == "a", {"state": F.lit("x")}).collect()) == [(1, "x", True), (2, None, False)]
    taken = spark.createDataFrame([("old-boys",)], "slug string")
    names = spark.createDataFrame([(1, "Old Boys", 1900), (2, "Old Boys", 1900), (3, "New", 5), (4, "", None)], "entity int, name string, year int")
    assert {r["entity"]: r["slug"] for r in decisions.slugs(names, taken).where("entity <> 2").collect()} == {1: "old-boys-1900", 3: "new", 4: "unnamed"}

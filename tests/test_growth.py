"""Keys larger than those of the given tables, and steps whose rows must not grow faster than the input."""

import os

import pytest
from parity import difference, duck

from touchline.operators import assembly, crosschecks, decisions, identity, ledger, models, text
from touchline.plans import catalog
from touchline.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far_players(tmp_path_factory):
    """The small tables with players' keys beyond a thousand, so that a key packed with another one spills into it."""
    folder = tmp_path_factory.mktemp("far")
    con = duck(SF)
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        columns = "* replace (l_suppkey * 7919 + l_linenumber * 100000 as l_suppkey)" if table == "lineitem" else "*"
        con.sql(f"copy (select {columns} from {table}) to '{folder}/{name}' (format parquet)")
    return str(folder)


def nodes(df):
    """(name, metrics, children) of every node that ran."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        metrics = node.metrics()
        known = {k: metrics.apply(k).value() for k in ("numOutputRows", "shuffleRecordsWritten") if metrics.contains(k)}
        children = node.children()
        return name, known, [walk(children.apply(k)) for k in range(children.size())]

    return walk(df._jdf.queryExecution().executedPlan())


def flat(node):
    yield node
    for child in node[2]:
        yield from flat(child)


def rows_into(node):
    """Rows of the nearest counted nodes below one."""
    return sum(sum(child[1].values()) if child[1] else rows_into(child) for child in node[2])


def most(df, metric):
    return max(n[1].get(metric, 0) for n in flat(nodes(df)))


@pytest.mark.parametrize("name", ["str7_final_reconciliation", "xt16_neutral_sites"])
def test_latest_read_by_both_keys(spark, far_players, name):
    assert difference(catalog.queries()[name](spark, far_players), catalog.oracle_sql()[name], duck(far_players)) == ""


def test_namesakes_make_no_pairs(spark):
    rows = spark.range(400).selectExpr("id", "'One Name' as name", "1 as born", "1 as country")
    theirs, ours = rows.withColumnRenamed("id", "athlete_id"), rows.selectExpr("id as player_id", "name", "born", "country", "cast(null as long) as other_id")
    windows = spark.createDataFrame([(1, 1995, 1)], "player_id long, season int, team_id int")
    df = decisions.corroborated(theirs, ours, windows, windows.withColumnRenamed("player_id", "athlete_id"))
    assert {(r["decision"], r["reason"]) for r in df.collect()} == {("queue", "multiple_candidates")}
    assert most(df, "numOutputRows") <= 2 * 400


def test_repeated_days_prove_once(spark):
    """Many matches of two teams on the same few days are met once for each day."""
    rows = spark.range(600).selectExpr("id % 4 as day", "1 as home", "2 as away")
    theirs = rows.selectExpr("day", "11 as home", "12 as away")
    df = identity.fixture_proof(rows, theirs)
    assert {r["provider_team"]: (r["fixtures"], r["canonical_team"]) for r in df.collect()} == {11: (4, 1), 12: (4, 2)}
    ran = list(flat(nodes(df)))
    assert max(n[1].get("numOutputRows", 0) for n in ran if "Join" in n[0]) <= 100


def test_pairs_of_namesakes_are_not_shuffled(spark):
    rows = spark.range(300).selectExpr("id", "'One' as name", "1 as born")
    alone = spark.createDataFrame([(1000, "Two", 2)], "id long, name string, born int")
    df = crosschecks.same_person(rows.unionByName(alone), rows.unionByName(alone))
    got = df.collect()
    assert len(got) == 300 * 300 + 1 and [r["a_id"] for r in got if r["unique"]] == [1000]
    assert most(df, "shuffleRecordsWritten") <= 8 * 301


def test_one_id_under_two_names_is_not_unique(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "z", 1), (None, "w", 1)], "id int, name string, born int")
    b = spark.createDataFrame([(5, "x", 1), (6, "y", 1), (7, "z", 1), (8, "w", 1)], "id int, name string, born int")
    got = {(r["a_id"], r["b_id"]): r["unique"] for r in crosschecks.same_person(a, b).collect()}
    assert got == {(1, 5): False, (1, 6): False, (2, 7): True, (None, 8): True}


def test_frames_of_strengths_hold_days(spark):
    """However many matches a day has, a moving frame holds a row for each team and day."""
    rows = spark.range(500).selectExpr(
        "id as match_id", "1 as competition_id", "id % 5 as day", "explode(array(struct(1 as team_id, true as is_home, 2 as gf, 1 as ga), struct(2 as team_id, false as is_home, 1 as gf, 2 as ga))) as x"
    ).select("match_id", "competition_id", "day", "x.*")
    df = models.decayed_strengths(rows)
    assert df.count() == 2 * 400
    windows = [n for n in flat(nodes(df)) if n[0] == "Window"]
    assert windows and max(rows_into(n) for n in windows) <= 4 * 2 * 5


def test_related_pairs_are_not_shuffled(spark):
    articles = spark.range(400).selectExpr("id", "'d' as desk", "id as day")
    entities = spark.range(400).selectExpr("id", "'Person' as type", "1 as entity")
    df = text.related(articles, entities)
    assert df.count() == 4 * 400
    assert most(df, "shuffleRecordsWritten") <= 400


@pytest.mark.parametrize("name", ["ag6_player_stats", "ag17_observed_record", "ag16_pr3_player_profile"])
def test_ledger_is_dealt_by_its_rows(spark, monkeypatch, name):
    """Parts follow the number of rows, and the results stay."""
    monkeypatch.setattr(tables, "LEDGER_ROWS", 600)
    df = catalog.queries()[name](spark, SF)
    assert difference(df, catalog.oracle_sql()[name], duck(SF)) == ""
    items = tables.table(spark, SF, "lineitem")
    assert tables.by_match(items).rdd.getNumPartitions() == items.count() // 600


EVENTS = "match_id int, team_id int, player_id int, sequence int, minute int, event_type string, subtype string, outcome string, card string, is_goal boolean, is_own_goal boolean"


def test_impact_is_one_pass(spark):
    """A player of both teams keeps a row for each, with the counters of both; the events are met with nothing."""
    events = spark.createDataFrame([(1, 1, 7, 1, 5, "shot", None, "success", None, True, False), (1, 2, 7, 9, 60, "pass", None, "fail", None, False, False), (1, 1, 8, 2, 9, "foul", None, "success", "red", False, False)], EVENTS)
    df = ledger.impact(events)
    got = sorted((r["player_id"], r["is_starter"], r["minutes"], r["n_goals"], r["n_passes"], r["n_events"]) for r in df.collect())
    assert got == [(7, False, 30, 1, 1, 2), (7, True, 90, 1, 1, 2), (8, True, 9, 0, 0, 1)]
    assert not [n for n in flat(nodes(df)) if "Join" in n[0]]


def test_load_is_one_pass(spark):
    """Starts in a row are counted without meeting a player's matches again."""
    rows = [(1, k, k * 3, 90, k != 2, False, "club") for k in range(1, 6)]
    df = assembly.player_load(spark.createDataFrame(rows, "player_id int, match_id int, day int, minutes int, started boolean, came_on boolean, team_kind string"))
    assert {r["match_id"]: r["starts_in_a_row"] for r in df.collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    assert not [n for n in flat(nodes(df)) if "Join" in n[0]]


def test_team_frames_of_elevens_hold_days(spark):
    df = catalog.queries()["pr8_eleven_load"](spark, SF)
    assert difference(df, catalog.oracle_sql()["pr8_eleven_load"], duck(SF)) == ""

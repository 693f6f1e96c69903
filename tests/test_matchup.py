"""Small fixtures of the comparisons before a match, stories and evidence, with literal results."""

from pyspark.sql import functions as F

from touchline.operators import matchup, newsroom, results
from touchline.streaming import live

EVENT = "match_id long, sequence int, source_family string, team_id int, home_team_id int, away_team_id int, event_type string, outcome string, is_goal boolean, is_own_goal boolean, x_m double, y_m double, minute int, set_piece boolean"


def event(match, sequence, family, team, kind="shot", outcome="fail", goal=False, own=False, at=(None, None), minute=10, set_piece=False):
    return (match, sequence, family, team, 1, 2, kind, outcome, goal, own, *at, minute, set_piece)


def rows(spark, scores):
    """Matches of team 1 at home against team 2, a day apart."""
    data = [(k, k * 10, 1, 2, h, a) for k, (h, a) in enumerate(scores, 1)]
    m = spark.createDataFrame(data, "match_id long, day long, home_team_id int, away_team_id int, home_score int, away_score int")
    return results.team_match(m.select("*", F.lit(1).alias("competition_id"), F.lit(2000).alias("season"), F.lit("finished").alias("status")))


def test_richest_family_and_own_goals(spark):
    data = [
        event(1, 1, "espn", 1), event(1, 2, "espn", 1), event(1, 3, "espn", 1),
        event(1, 1, "wyscout_figshare", 1, at=(100.0, 34.0), set_piece=True), event(1, 2, "wyscout_figshare", 2, outcome="success", goal=True, minute=46), event(1, 3, "wyscout_figshare", 2, kind="touch", own=True),
    ]
    got = {(r["match_id"], r["team_id"]): r for r in matchup.games(rows(spark, [(1, 1), (0, 0)]), spark.createDataFrame(data, EVENT)).collect()}
    home, away = got[1, 1], got[1, 2]
    assert (home["family"], home["shots"], home["o_shots"], home["inside"], home["set_pieces"]) == ("wyscout_figshare", 1, 1, 1, 1)
    assert (home["first"], home["o_second"], away["second"], away["o_first"]) == (1, 1, 1, 1)
    assert got[2, 1]["shots"] is None


def test_the_day_itself_does_not_count(spark):
    none = spark.createDataFrame([], EVENT)
    played = matchup.games(rows(spark, [(1, 0), (2, 2), (0, 9)]), none)
    p = {r["team_id"]: r for r in matchup.team_profile(played, 30).collect()}
    assert (p[1]["matches"], p[1]["form"], p[1]["goals_for"], p[1]["shots_for"]) == (2, "DW", 1.5, None)
    assert {r["team_id"]: (r["rest"], r["last_7"], r["last_14"]) for r in matchup.schedule(played, 30).collect()} == {1: (10, 0, 1), 2: (10, 0, 1)}


def test_analyzer_withholds_thin_ratings(spark):
    fixture = spark.createDataFrame([(9, 40, 1, 2000, 1, 2)], "match_id long, day long, competition_id int, season int, home_team_id int, away_team_id int")
    starters = spark.createDataFrame([], "match_id long, team_id int, player_id long")
    none = spark.createDataFrame([], EVENT)
    thin, enough = (matchup.analyzer(fixture, matchup.games(rows(spark, [(3, 0)] * n), none), starters, 40).first() for n in (2, 3))
    assert thin["home_rating"] is None and thin["label"] == "withheld"
    # Every edge of the results is a full one (also by venue: one side at home, the other away); the calendars are alike.
    assert (enough["home_rating"], enough["away_rating"], enough["label"]) == (86, 14, "results and schedule")
    assert enough["omitted"] == "shots,suppression,shot_diff,target_diff,eleven"


def test_a_run_is_told_once(spark):
    told = lambda scores, now=1000: {(r["subject"], r["kind"], r["run"], r["score"]) for r in newsroom.team_trends(rows(spark, scores), now, 4000).collect()}
    assert told([(1, 0)] * 7) == {(1, "winning_run", 7, 1.4), (2, "losing_run", 7, 1.4)}
    assert told([(0, 0)] + [(1, 0)] * 6) == {(1, "winning_run", 6, 1.4), (1, "unbeaten_run", 7, 1.0), (2, "losing_run", 6, 1.4), (2, "winless_run", 7, 1.0)}
    assert told([(1, 0)] * 4 + [(0, 1)]) == set()
    assert told([(1, 0)] * 4 + [(0, 1)], now=45) == {(1, "winning_run", 4, 1.0), (2, "losing_run", 4, 1.0)}


def test_evidence_names_what_is_missing(spark):
    assembled = spark.createDataFrame(
        [(1, "finished", 1, 2, 2, 0, 0, 0, 0, 0, 0, "", "", None), (2, "scheduled", 1, 2, None, None, 0, 0, 0, 0, 0, "", "", None)],
        "match_id long, status string, home_team_id int, away_team_id int, home_score int, away_score int, n_events long, home_shots long, away_shots long, home_on_target long, away_on_target long, timeline string, lineup string, busiest long",
    )
    loads = spark.createDataFrame([(1, 1, 40.0), (1, 2, 12.5)], "match_id long, team_id int, load double")
    angles = spark.createDataFrame([], "match_id long, angles string")
    (packet,) = newsroom.evidence(assembled, loads, angles).collect()
    assert (packet["n_facts"], packet["missing"], packet["depth"]) == (2, "goals,shots,on_target,lineup,busiest,angles", "result")


def test_record_over_the_last_picks(spark):
    grades = spark.createDataFrame([(k, k, 0.5, g) for k, g in enumerate(["won", "lost", "won", "void", "pending"])], "match_id long, day long, probability double, grade string")
    got = {r["last"]: (r["picks"], r["won"], r["lost"], r["void"], r["hit_rate"]) for r in newsroom.record_windows(grades, (2, 9)).collect()}
    assert got == {2: (2, 1, 0, 1, 1.0), 9: (4, 2, 1, 1, 0.6667)}


def test_waits(spark):
    ticks = spark.createDataFrame([("a", at, o) for at, o in [(0, "failed"), (60, "failed"), (120, "failed"), (180, "ok"), (500, "blocked"), (4000, "ok"), (4200, "ok")]], "provider string, at long, outcome string")
    got = [(r["at"], r["until"], r["early"]) for r in live.waits(ticks).orderBy("at").collect()]
    assert got == [(0, None, False), (60, None, False), (120, 420, False), (180, None, True), (500, 4100, False), (4000, None, True), (4200, None, False)]

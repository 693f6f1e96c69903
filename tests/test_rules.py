"""Literal results of column rules."""

from pyspark.sql import functions as F

from touchline.functions import exprs as x
from touchline.functions import rules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_notes_and_words(spark):
    note = F.lit("A: title; B-D: qualified; E: relegated")
    assert [one(spark, rules.zone_note(note, F.lit(letter))) for letter in "ACEZ"] == ["title", "qualified", "relegated", None]
    assert one(spark, rules.number_words(F.lit("Two goals in twelve minutes, not thirteen"))) == [2, 12]
    assert one(spark, rules.stage_role(F.lit("Relegation Play-offs"))) == "playoff"
    assert one(spark, rules.stage_key(F.lit(" Group Stage: A "))) == "group_stage_a"


def test_goals_and_names(spark):
    team = lambda own, family: one(spark, rules.beneficiary(F.lit(own), F.lit(1), F.lit(1), F.lit(2), F.lit(family)))
    assert [team(True, "wyscout_figshare"), team(True, "espn"), team(False, "espn")] == [2, 1, 1]
    assert one(spark, rules.phrase_in(F.lit("FC Köln - Bayern 2:1"), F.lit("Koln"))) and not one(spark, rules.phrase_in(F.lit("Kölner"), F.lit("Köln")))
    assert one(spark, rules.names_match(F.lit("Müller"), "MULL")) and not one(spark, rules.names_match(F.lit("Müller"), "m"))
    assert one(spark, x.winner(F.lit(1), F.lit(2), F.lit(0), F.lit(0))) is None


def test_licences_and_outcomes(spark):
    kind = lambda text, author, non_free=False: one(spark, rules.licence(F.lit(text), F.lit(None), F.lit("https://licence.example"), F.lit(author), F.lit(non_free), F.lit(False)))
    assert [kind("CC BY 4.0", "someone"), kind("CC BY 4.0", None), kind("CC0", None), kind("All rights reserved", "x", True), kind(None, None)] == ["approved", "review_required", "approved", "rejected", "review_required"]
    assert one(spark, rules.outcome(F.lit("shot"), F.array(F.lit(1801), F.lit(101)))) == "goal"
    assert one(spark, rules.event_kind(F.lit(99), F.lit(99))) is None
    now = F.lit("2024-05-01 15:00:00").cast("timestamp")
    state = lambda status, at: one(spark, rules.match_state(F.lit(status), F.lit(at).cast("timestamp"), now))
    assert [state("scheduled", f"2024-05-01 {h}") for h in ("15:00:01", "15:00:00", "12:00:01", "12:00:00")] == ["scheduled", "live", "live", "unknown"] and state("finished", "2024-05-01 14:00:00") == "finished"

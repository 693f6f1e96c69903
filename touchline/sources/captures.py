"""Raw provider captures: JSON parsing into typed rows, group trees, a content-addressed archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import normal_url

c = F.col

MATCH = "wyId long, competitionId long, seasonId long, gameweek int, dateutc string, status string, duration string, teamsData map<string, struct<side: string, teamId: long, score: int, scoreHT: int, formation: struct<lineup: array<struct<playerId: long>>, bench: array<struct<playerId: long>>, substitutions: array<struct<playerIn: long, playerOut: long, minute: int>>>>>"
EVENT = "id long, matchId long, matchPeriod string, eventSec double, eventId int, subEventId int, teamId long, playerId long, tags array<struct<id: int>>, positions array<struct<x: int, y: int>>"
MATCHDAY = "matchID long, matchDateTimeUTC string, team1 struct<teamId: long, teamName: string>, team2 struct<teamId: long, teamName: string>, matchIsFinished boolean, matchResults array<struct<resultTypeID: int, resultName: string, pointsTeam1: int, pointsTeam2: int>>, goals array<struct<goalID: long, scoreTeam1: int, scoreTeam2: int, matchMinute: int, goalGetterID: long, isPenalty: boolean, isOwnGoal: boolean>>"
PERIODS = {"1H": 1, "2H": 2, "E1": 3, "E2": 4, "P": 5}
#: Tags of the event files, by number.
GOAL, OWN_GOAL, ACCURATE = 101, 102, 1801


def parsed(raw: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """One row per object of a JSON array, or of a single object, in a text column; what doesn't parse gives no rows."""
    array = F.when(F.ltrim(body).startswith("["), c(body)).otherwise(F.concat(F.lit("["), c(body), F.lit("]")))
    whole = f"array<struct<{schema_fields(schema)}>>"
    return raw.select(F.explode(F.from_json(array, whole)).alias("r")).select("r.*").where(F.coalesce(*[c(x) for x in [schema.split(" ", 1)[0]]]).isNotNull())


def schema_fields(schema: str) -> str:
    """DDL of columns as the fields of a struct (name: type)."""
    out, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += ch
    return ", ".join(out)


def match_sides(raw: DataFrame) -> DataFrame:
    """Match files: a row for each side, with score and players."""
    m = parsed(raw, MATCH)
    return m.select("wyId", "dateutc", "status", F.explode("teamsData").alias("key", "t")).select(
        c("wyId").alias("match_id"), "dateutc", "status", "t.side", c("t.teamId").alias("team_id"), c("t.score").alias("score"), c("t.scoreHT").alias("score_ht"),
        F.transform("t.formation.lineup", lambda p: p["playerId"]).alias("lineup"), F.coalesce(F.size("t.formation.substitutions"), F.lit(0)).alias("n_substitutions"),
    )


def sequenced_events(raw: DataFrame) -> DataFrame:
    """Event files in order of period, clock and id, numbered from 1 in each match; goals by tag."""
    period = F.element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), c("matchPeriod"))
    tags = F.transform("tags", lambda t: t["id"])
    order = Window.partitionBy("matchId").orderBy(period, "eventSec", "id")
    return parsed(raw, EVENT).select(
        c("matchId").alias("match_id"), F.row_number().over(order).alias("sequence"), "id", c("teamId").alias("team_id"), c("playerId").alias("player_id"),
        F.array_contains(tags, GOAL).alias("is_goal"), F.array_contains(tags, OWN_GOAL).alias("is_own_goal"),
        F.when(F.array_contains(tags, ACCURATE), "success").otherwise("fail").alias("outcome"),
        F.get(F.transform("positions", lambda p: p["x"] * 1.05), F.lit(0)).alias("x_m"),
    )


def result_of(kind: int, name: str) -> Column:
    """A matchday feed's result by its type's number, or by its name."""
    return F.get(F.filter("matchResults", lambda r: (r["resultTypeID"] == kind) | F.lower(r["resultName"]).contains(name)), F.lit(0))


def matchday(raw: DataFrame) -> DataFrame:
    return parsed(raw, MATCHDAY).select(
        c("matchID").alias("match_id"), "matchDateTimeUTC", c("team1.teamId").alias("home"), c("team2.teamId").alias("away"), c("matchIsFinished").alias("finished"),
        result_of(2, "end")["pointsTeam1"].alias("home_score"), result_of(2, "end")["pointsTeam2"].alias("away_score"), result_of(1, "half")["pointsTeam1"].alias("home_ht"), F.size("goals").alias("n_goals"),
    )


def group_leaves(spark: SparkSession, groups: DataFrame, depth: int = 3) -> DataFrame:
    """Leaves of a forest (id, parent) with their root and level, by a recursive query."""
    groups.createOrReplaceTempView("groups_of_tree")
    return spark.sql(f"""
        with recursive walk(id, root, level) as (
          select id, id, 0 from groups_of_tree where parent is null
          union all select g.id, w.root, w.level + 1 from groups_of_tree g join walk w on g.parent = w.id where w.level < {depth})
        select id, root, level from walk where id not in (select parent from groups_of_tree where parent is not null)""")


def archive(captures: DataFrame, path: str) -> DataFrame:
    """Write captures (url, content) under the hash of their content, once: what is stored already is left. Returns the captures' records."""
    spark = captures.sparkSession
    keyed = captures.select(normal_url(c("url")).alias("url"), "content", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha"))
    new = keyed.groupBy("sha").agg(F.min("content").alias("content")).withColumn("prefix", F.substring("sha", 1, 2))
    try:
        new = new.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("prefix").parquet(path)
    return keyed.select("url", "sha", F.octet_length("content").alias("bytes"))


def escapes_decoded(text: Column) -> Column:
    """Backslash-u escapes to their characters; a text that isn't valid as a JSON string stays as it is."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v"), text)


def key_lookup(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the keys; the smaller side is broadcast where Spark finds it small."""
    return rows.join(keys.select(on).distinct(), on, "left_semi")

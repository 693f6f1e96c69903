"""Ingest: change-tracked upserts, guards, reconciliation, retry ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


@dataclass
class Diff:
    """What an upsert would do: new rows, changed rows, rows left as they are, and a row per changed field."""

    inserted: DataFrame
    updated: DataFrame
    unchanged: DataFrame
    changes: DataFrame


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows; raises if a key occurs twice."""
    twice = duplicates(rows, *keys).limit(3).collect()
    if twice:
        raise ValueError(f"duplicate keys {[tuple(r) for r in twice]}")
    return rows


def classified(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Incoming rows with what happens to each (action) and old_<field>; values are compared null-safe after a cast to the stored types."""
    types = dict(existing.dtypes)
    new = incoming.select(*keys, *[c(f).cast(types[f]).alias(f) for f in fields])
    old = existing.select(*keys, *[c(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("stored"))
    both = new.join(old, keys, "left")
    same = F.lit(True)
    for f in fields:
        same = same & c(f).eqNullSafe(c(f"old_{f}"))
    return both.withColumn("action", F.when(c("stored").isNull(), "insert").when(same, "same").otherwise("update")).drop("stored")


def diff_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> Diff:
    rows = classified(existing, incoming, keys, fields)
    of = lambda action: rows.where(c("action") == action).select(*keys, *fields)
    return Diff(of("insert"), of("update"), of("same"), changes(rows, keys, fields))


def changes(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per changed field: field, old_value, new_value as text."""
    text = lambda x: c(x).cast("string")
    each = F.array(*[F.struct(F.lit(f).alias("field"), text(f"old_{f}").alias("old_value"), text(f).alias("new_value")) for f in fields])
    return rows.where("action = 'update'").select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("not (old_value <=> new_value)")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key isn't incoming, and all incoming rows."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def best_listing(matches: DataFrame) -> DataFrame:
    """One row per (home, away): finished first, then the latest day, then the highest id; others are counted."""
    order = Window.partitionBy("home_team_id", "away_team_id").orderBy((c("status") == "finished").desc(), F.desc("day"), F.desc("match_id"))
    listed = matches.select("match_id", "home_team_id", "away_team_id", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("home_team_id", "away_team_id")).alias("n"))
    return listed.where("k = 1").select("match_id", "home_team_id", "away_team_id", (c("n") - 1).alias("others"))


def reconcile(stored: DataFrame, snapshot: DataFrame, group: str, key: str, place: str, most_gone: float = 0.5) -> DataFrame:
    """Compare a complete re-read with the stored ledger, group by group.

    gone, moved and kept rows are counted; a group that would lose more than ``most_gone`` of its
    rows is held as a glitch.
    """
    old = stored.select(group, key, c(place).alias("old_place"))
    new = snapshot.select(group, key, c(place).alias("new_place"))
    both = old.join(new, [group, key], "full")
    out = both.groupBy(group).agg(
        F.count_if(c("new_place").isNull()).alias("gone"), F.count_if(c("old_place").isNull()).alias("added"),
        F.count_if(c("old_place") != c("new_place")).alias("moved"), F.count("old_place").alias("n_stored"),
    )
    return out.withColumn("held", F.expr(f"n_stored > 0 and gone > {most_gone} * n_stored"))


def backoff_minutes(attempts: Column, first: int = 30, most: int = 24 * 60) -> Column:
    """first * 2 ** (attempts - 1), at most ``most``."""
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), F.least(attempts, F.lit(30)) - 1)).cast("long")


def enrichment(attempts: DataFrame, cap: int = 8) -> DataFrame:
    """Ledger of (match, component) from its attempts: status, attempts, minutes until the next; complete stays complete."""
    out = attempts.groupBy("match_id", "component").agg(F.count("*").alias("attempts"), F.max("complete").alias("complete"))
    status = F.when(c("complete"), "complete").when(c("attempts") >= cap, "exhausted").otherwise("pending")
    return out.select("match_id", "component", "attempts", status.alias("status"), F.when(status == "pending", backoff_minutes(c("attempts"))).alias("retry_in"))


def agreement(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """How often two sources agree on each field, where both have a value."""
    both = a.select(key, *fields).join(b.select(key, *[c(f).alias(f"other_{f}") for f in fields]), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("x"), c(f"other_{f}").alias("y")) for f in fields])
    known = both.select(F.explode(each).alias("e")).select("e.*").where("x is not null and y is not null")
    return known.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(c("x") == c("y")).alias("equal"))


def lane_state(runs: DataFrame) -> DataFrame:
    """Health of a lane from its ordered runs (lane, at, ok): failures in a row at the end, wait in minutes."""
    newest = Window.partitionBy("lane").orderBy(F.desc("at"))
    ranked = runs.withColumn("k", F.row_number().over(newest))
    out = ranked.groupBy("lane").agg(F.coalesce(F.min(F.when(c("ok"), c("k"))) - 1, F.max("k")).cast("long").alias("failures"), F.count("*").alias("runs"))
    health = F.when(c("failures") == 0, "ok").when(c("failures") < 3, "degraded").otherwise("blocked")
    return out.select("lane", "runs", "failures", health.alias("health"), F.when(c("failures") > 0, backoff_minutes(c("failures"), 5, 360)).otherwise(F.lit(0)).cast("long").alias("wait"))

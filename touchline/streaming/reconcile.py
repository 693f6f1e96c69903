"""The live lane against its owner, as streams: finals, lasting differences, ledger corrections.

Finals and reads are two streams, met by an outer join with a time bound. The other two rules
depend on the order of a match's reads, which arrive in any order: reads wait in list state
until the watermark has passed them, and a timer then hands them on by time. What is kept of a
match is its open reads and one value, so state is bounded by a match.

The processors need a state store with several state variables (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def final_checks(finals: DataFrame, reads: DataFrame, reach: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    """One row for each final: whether the observer's last read around it agrees, differs, or is missing.

    finals: match_id, finished_at, home, away (the owner's); reads: match_id, read_at, home, away.
    Of a stream, a final is answered once, when no read within ``reach`` of it can come any more;
    rows later than ``late`` behind their stream are lost to it, as they are to any stream.
    """
    owner, seen = (x.withWatermark(at, late) if x.isStreaming else x for x, at in ((finals, "finished_at"), (reads, "read_at")))
    owner = owner.select("match_id", "finished_at", c("home").alias("owner_home"), c("away").alias("owner_away"))
    seen = seen.select(c("match_id").alias("of"), "read_at", c("home").alias("their_home"), c("away").alias("their_away"))
    near = (c("match_id") == c("of")) & (c("read_at") >= c("finished_at") - F.expr(f"interval {reach}")) & (c("read_at") <= c("finished_at") + F.expr(f"interval {reach}"))
    # The read's time as a number: the final's alone stays the event time of what follows.
    met = owner.join(seen, near, "left").select("match_id", "finished_at", "owner_home", "owner_away", F.unix_micros("read_at").alias("at"), "their_home", "their_away")
    last = met.groupBy("match_id", "finished_at", "owner_home", "owner_away").agg(F.max(F.struct("at", "their_home", "their_away")).alias("last"), F.count("at").alias("reads"))
    agree = c("last.their_home").eqNullSafe(c("owner_home")) & c("last.their_away").eqNullSafe(c("owner_away"))
    result = F.when(c("reads") == 0, "missing").when(agree, "agrees").otherwise("differs")
    return last.select("match_id", "finished_at", "reads", result.alias("result"))


class InOrder(StatefulProcessor):
    """Rows of a key by time, whatever the order of arrival: they wait until the watermark has passed.

    Subclasses have ``waiting`` (DDL of a row, with its time in microseconds first), ``kept`` (DDL
    of the value), ``start`` (its first value) and ``take(value, row) -> value, rows out``.
    """

    waiting = ""
    kept = ""
    start: tuple = ()
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.kept)
        self.rows = handle.getListState("rows", self.waiting)

    def take(self, value: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: list[tuple] = []
        for pdf in rows:
            came += [self.of(r) for r in pdf.to_dict("records")]
        self.rows.appendList(came)
        for at in sorted({r[0] for r in came}):
            self.handle.registerTimer(-(-at // 1000))  # in milliseconds, never before the row
        yield pd.DataFrame()

    def of(self, row: dict) -> tuple:
        """A waiting row from an arrived one."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(tuple(r) for r in self.rows.get())
        due, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        if not due:
            return
        if rest:
            self.rows.put(rest)
        else:
            self.rows.clear()
        value = tuple(self.value.get()) if self.value.exists() else self.start
        out: list[tuple] = []
        for row in due:
            value, made = self.take(value, row)
            out += made
        self.value.update(value)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)


class Differing(InOrder):
    """A pair of scores that has differed for ``patience`` is logged once."""

    waiting = "at bigint, theirs string, ours string"
    kept = "pair string, since bigint, logged boolean"
    start = ("", 0, False)
    columns = ["match_id", "pair", "since", "logged_at"]

    def __init__(self, patience_us: int):
        self.patience = patience_us

    def of(self, row: dict) -> tuple:
        return int(row["at"]), row["theirs"], row["ours"]

    def take(self, value: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        at, theirs, ours = row
        if theirs == ours:
            return self.start, []
        pair = "|".join(x for x in (theirs, ours) if x is not None)
        was, since, logged = value
        if was != pair:
            since, logged = at, False
        log = not logged and at - since >= self.patience
        return (pair, since, logged or log), [(pair, since, at)] if log else []


def lasting_differences(reads: DataFrame, patience_us: int, late: str = "10 minutes") -> DataFrame:
    """The stream of differences that lasted: (match_id, read_at, theirs, ours); times come out in microseconds."""
    rows = reads.withWatermark("read_at", late).select("match_id", "read_at", F.unix_micros("read_at").alias("at"), "theirs", "ours")
    return rows.groupBy("match_id").transformWithStateInPandas(Differing(patience_us), "match_id bigint, pair string, since bigint, logged_at bigint", "append", "eventTime")


GLITCH_SHARE = 0.5
CONFIRMING_READS = 3


def corrected(value: tuple, read: list[str]) -> tuple[tuple, list[tuple]]:
    """A ledger after a complete read of it: (plays in order, signature, reads) and (action, play, sequence, reason).

    A play that is read no more is withdrawn, one at another place is resequenced. If more than
    GLITCH_SHARE of the ledger is gone the read is held and changes nothing, until CONFIRMING_READS
    reads in a row miss the same plays.
    """
    ledger, signature, held = value
    new, old = {p: k + 1 for k, p in enumerate(read)}, {p: k + 1 for k, p in enumerate(ledger)}
    gone = sorted(p for p in old if p not in new)
    reason = "not_in_complete_read"
    if gone and len(gone) > len(old) * GLITCH_SHARE:
        missing = ",".join(gone)
        held = held + 1 if missing == signature else 1
        if held < CONFIRMING_READS:
            return (ledger, missing, held), [("held", None, len(gone), "provider_glitch_suspected")]
        reason = "withdrawn_after_hold"
    out = [("withdrawn", p, old[p], reason) for p in gone]
    out += [("resequenced", p, k, None) for p, k in new.items() if p in old and old[p] != k]
    out += [("added", p, k, None) for p, k in new.items() if p not in old]
    return (list(new), "", 0), out


class Ledger(InOrder):
    """The standing ledger of a match, from its complete reads."""

    waiting = "at bigint, plays array<string>"
    kept = "plays array<string>, signature string, reads int"
    start = ([], "", 0)
    columns = ["match_id", "at", "action", "play_id", "sequence", "reason"]

    def of(self, row: dict) -> tuple:
        return int(row["at"]), [str(p) for p in row["plays"]]

    def take(self, value: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        value = (list(value[0]), value[1], value[2])
        value, made = corrected(value, list(row[1]))
        return value, [(row[0], *m) for m in made]


def ledger_corrections(reads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream of corrections: (match_id, read_at, plays: ids in order) of complete reads."""
    rows = reads.withWatermark("read_at", late).select("match_id", "read_at", F.unix_micros("read_at").alias("at"), "plays")
    return rows.groupBy("match_id").transformWithStateInPandas(Ledger(), "match_id bigint, at bigint, action string, play_id string, sequence int, reason string", "append", "eventTime")


def folded_corrections(reads: DataFrame) -> DataFrame:
    """The same over a table of reads (match_id, at in microseconds, plays), as a fold over each match's reads in order."""
    plays = "array<string>"
    fact = "array<struct<at:bigint,action:string,play_id:string,sequence:int,reason:string>>"
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(plays).alias("ledger"), F.lit("").alias("signature"), F.lit(0).alias("held"), F.array().cast(fact).alias("out"))

    def fact_of(at, action, play, sequence, reason):
        return F.struct(at.alias("at"), F.lit(action).alias("action"), play.alias("play_id"), sequence.cast("int").alias("sequence"), reason.alias("reason"))

    def step(s, r):
        old, new = s["ledger"], r["plays"]
        gone = F.array_sort(F.array_except(old, new))
        missing = F.array_join(gone, ",")
        suspect = F.size(gone) > F.size(old) * GLITCH_SHARE
        held = F.when(suspect, F.when(missing == s["signature"], s["held"] + 1).otherwise(1)).otherwise(0)
        hold = suspect & (held < CONFIRMING_READS)
        reason = F.when(suspect, "withdrawn_after_hold").otherwise("not_in_complete_read")
        place = lambda ledger, p: F.array_position(ledger, p)
        withdrawn = F.transform(gone, lambda p: fact_of(r["at"], "withdrawn", p, place(old, p), reason))
        moved = F.transform(F.filter(new, lambda p: (place(old, p) > 0) & (place(old, p) != place(new, p))), lambda p: fact_of(r["at"], "resequenced", p, place(new, p), none))
        added = F.transform(F.array_except(new, old), lambda p: fact_of(r["at"], "added", p, place(new, p), none))
        note = F.array(fact_of(r["at"], "held", none, F.size(gone), F.lit("provider_glitch_suspected")))
        return F.struct(
            F.when(hold, old).otherwise(new).alias("ledger"), F.when(hold, missing).otherwise("").alias("signature"), F.when(hold, held).otherwise(0).alias("held"),
            F.concat(s["out"], F.when(hold, note.cast(fact)).otherwise(F.concat(withdrawn, moved, added).cast(fact))).alias("out"),
        )

    ordered = reads.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("at", "plays"))).alias("reads"))
    return ordered.select("match_id", F.explode(F.aggregate("reads", start, step)["out"]).alias("x")).select("match_id", "x.*")

"""Streams against their batch relations: late, repeated and lost rows, restarts, replayed batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.operators import desk
from touchline.streaming import reconcile as r
from touchline.streaming.upsert import TrackedTable, follow

T0 = datetime(2024, 5, 1, 12, 0)
at = lambda minutes: T0 + timedelta(minutes=minutes)
FINAL = "match_id long, finished_at timestamp, home int, away int"
READ = "match_id long, read_at timestamp, home int, away int"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    r.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """A folder to which rows are added, and the stream over it."""

    def __init__(self, spark, path, schema):
        path.mkdir(parents=True, exist_ok=True)
        self.spark, self.path, self.schema = spark, f"file://{path}", schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(out, tmp, name):
    out.writeStream.format("parquet").option("path", f"file://{tmp}/{name}").option("checkpointLocation", f"file://{tmp}/{name}-at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"file://{tmp}/{name}")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_finals_meet_their_reads_once(spark, tmp_path):
    finals, reads = Feed(spark, tmp_path / "finals", FINAL), Feed(spark, tmp_path / "reads", READ)
    all_finals = [(1, at(110), 2, 1), (2, at(112), 0, 0), (3, at(115), 1, 1), (5, at(118), 3, 0)]
    first = [(1, at(100), 1, 1), (2, at(109), 0, 1), (9, at(111), 4, 4), (5, at(60), 3, 0)]
    later = [(1, at(108), 2, 1), (1, at(104), 2, 0), (2, at(111), 0, 1)]  # late, out of order, but within the watermark
    end_f, end_r = [(99, at(2000), 0, 0)], [(99, at(2000), 0, 0)]
    finals.add(all_finals[:2]), reads.add(first)
    out = r.final_checks(finals.stream(), reads.stream(), reach="30 minutes")
    run(out, tmp_path, "out")
    finals.add(all_finals[2:]), reads.add(later)
    run(out, tmp_path, "out")
    finals.add(end_f), reads.add(end_r)
    run(out, tmp_path, "out")
    reads.add([(3, at(115), 1, 1)]), finals.add([(98, at(2001), 0, 0)])  # far behind the watermark: lost, and match 3 stays missing
    got = rows_of(run(out, tmp_path, "out").where("match_id < 90"))
    plain = r.final_checks(spark.createDataFrame(all_finals, FINAL), spark.createDataFrame(first + later, READ), reach="30 minutes")
    assert got == rows_of(plain)
    assert [(m, result) for m, _, _, result in got] == [(1, "agrees"), (2, "differs"), (3, "missing"), (5, "missing")]


def test_lasting_differences_equal_the_batch_relation(spark, tmp_path):
    schema = "match_id long, read_at timestamp, theirs string, ours string"
    rows = [(1, at(k), "1-0" if k < 40 else "1-1", "0-0" if k < 25 else "1-0" if k < 60 else "1-1") for k in range(0, 70, 2)]
    rows += [(2, at(k), "2-0", "2-0" if k % 9 else "1-0") for k in range(70)]  # never lasts
    feed = Feed(spark, tmp_path / "reads", schema)
    out = r.lasting_differences(feed.stream(), 10 * 60_000_000)
    for part in (rows[1::2] + rows[:1], rows[2::2]):  # every other read comes a batch late
        feed.add(part)
    feed.add([(99, at(3000), "0-0", "0-0")])
    got = rows_of(run(out, tmp_path, "out"))
    plain = desk.disagreements(spark.createDataFrame(rows, schema).select("match_id", F.unix_micros("read_at").alias("at"), "theirs", "ours"), 10 * 60_000_000)
    assert got == rows_of(plain.select("match_id", "pair", "since", "logged_at")) and len(got) == 2


READS = [  # match 1: a play withdrawn; match 2: a glitch, then a confirmed one; match 3: moved plays
    (1, 0, "a b c d"), (1, 1, "a b c d e"), (1, 2, "a b d e"),
    (2, 0, "a b c d"), (2, 1, "a"), (2, 2, "a b c d e"), (2, 3, "e"), (2, 4, "e"), (2, 5, "e"), (2, 6, "e f"),
    (3, 0, "a b c"), (3, 1, "b a c"), (3, 2, ""), (3, 3, "c"), (3, 4, ""), (3, 5, ""), (3, 6, "b a c"),
]
EXPECTED = {  # by hand: additions of the first reads left out
    (1, 1, "added", "e", 5, None), (1, 2, "withdrawn", "c", 3, "not_in_complete_read"), (1, 2, "resequenced", "d", 3, None), (1, 2, "resequenced", "e", 4, None),
    (2, 1, "held", None, 3, "provider_glitch_suspected"), (2, 2, "added", "e", 5, None), (2, 3, "held", None, 4, "provider_glitch_suspected"), (2, 4, "held", None, 4, "provider_glitch_suspected"),
    *((2, 5, "withdrawn", p, k + 1, "withdrawn_after_hold") for k, p in enumerate("abcd")), (2, 5, "resequenced", "e", 1, None), (2, 6, "added", "f", 2, None),
    (3, 1, "resequenced", "b", 1, None), (3, 1, "resequenced", "a", 2, None),
    *((3, k, "held", None, n, "provider_glitch_suspected") for k, n in ((2, 3), (3, 2), (4, 3), (5, 3))),
}


def test_glitches_are_held_out_of_order_and_over_a_restart(spark, tmp_path):
    schema = "match_id long, read_at timestamp, plays array<string>"
    rows = [(m, at(k), p.split()) for m, k, p in READS]
    feed = Feed(spark, tmp_path / "reads", schema)
    out = r.ledger_corrections(feed.stream())
    feed.add(rows[::-1][3:9] + rows[:2])
    run(out, tmp_path, "out")  # every run starts from the checkpoint of the one before
    feed.add([x for x in rows if x not in rows[::-1][3:9] + rows[:2]])
    run(out, tmp_path, "out")
    feed.add([(99, at(3000), [])])
    got = run(out, tmp_path, "out")
    run(out, tmp_path, "out")
    minute = ((F.col("at") - F.unix_micros(F.lit(T0))) / 60_000_000).cast("int")
    plain = r.folded_corrections(spark.createDataFrame(rows, schema).select("match_id", F.unix_micros("read_at").alias("at"), "plays"))
    assert rows_of(got) == rows_of(plain)
    facts = {tuple(x) for x in got.select("match_id", minute, "action", "play_id", "sequence", "reason").collect()}
    first = {(m, 0, "added", p, k + 1, None) for m, n, ps in READS if n == 0 for k, p in enumerate(ps.split())}
    assert facts == EXPECTED | first


ROW = StructType().add("key", "long").add("at", "long").add("score", "string").add("status", "string")


def table_of(spark, path, **more):
    return TrackedTable(spark, f"file://{path}", ROW, ["key"], "at", **more)


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    one = spark.createDataFrame([(1, 1, "0-0", "live"), (2, 1, "0-0", "live"), (1, 2, "1-0", "live")], ROW)
    two = spark.createDataFrame([(1, 3, "1-0", "finished"), (2, 0, "9-9", "late"), (3, 3, None, "live")], ROW)
    assert t.apply(one, 0) and t.apply(two, 1)
    before = rows_of(t.rows()), rows_of(t.changes()), rows_of(t.commits())
    assert not t.apply(two, 1) and not t.apply(one, 0)
    assert before == (rows_of(t.rows()), rows_of(t.changes()), rows_of(t.commits()))
    assert before[0] == [(1, 3, "1-0", "finished"), (2, 1, "0-0", "live"), (3, 3, None, "live")]
    assert before[1] == [(1, "status", "live", "finished", 1)]


def test_a_batch_that_died_before_its_commit_is_written_anew(spark, tmp_path):
    t = table_of(spark, tmp_path / "t")
    one = spark.createDataFrame([(1, 1, "0-0", "live")], ROW)
    t.apply(one, 0)
    # As a died batch leaves it: rows without a commit.
    spark.createDataFrame([(1, 7, "7-7", "broken", 1), (8, 7, "7-7", "broken", 1)], StructType([*ROW]).add("written", "long")).write.parquet(f"{t.path}/rows/batch=1")
    assert rows_of(t.rows()) == [(1, 1, "0-0", "live")]
    t.apply(spark.createDataFrame([(1, 2, "1-0", "live")], ROW), 1)
    assert rows_of(t.rows()) == [(1, 2, "1-0", "live")] and rows_of(t.changes()) == [(1, "score", "0-0", "1-0", 1)]


def test_a_followed_stream_equals_its_last_rows_with_compaction(spark, tmp_path):
    feed, t = Feed(spark, tmp_path / "in", ROW), table_of(spark, tmp_path / "t", compact=2)
    rows = [(k % 7, k, f"{k % 3}-0", "live" if k < 40 else "finished") for k in range(60)]
    for n in range(0, 60, 15):
        feed.add(rows[n : n + 15])
        follow(feed.stream(), t, f"file://{tmp_path}/at")
    follow(feed.stream(), t, f"file://{tmp_path}/at")  # nothing new: no batch
    assert len(t.committed()) == 4 and len(t._finished("base")) == 2
    assert rows_of(t.rows()) == sorted(rows[-7:], key=str)

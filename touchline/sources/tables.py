"""Tables of a folder, and the match, ledger and team tables shaped from them.

The shaped tables are synthetic: they have the shape of a match database, with values made
of the orders' keys, so results are checked against SQL and small fixtures, not football.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def teams(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("group_id"))


def matches(spark: SparkSession, path: str) -> DataFrame:
    """match_id, competition_id, season, kickoff_at, day, home/away team, status, scores."""
    orders = table(spark, path, "orders")
    customer = table(spark, path, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, path, "nation").select("n_nationkey", "n_regionkey")
    key = F.col("o_orderkey")
    finished = F.col("o_orderstatus") == "F"
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("match_id"),
        F.col("n_regionkey").alias("competition_id"),
        F.year("o_orderdate").cast("int").alias("season"),
        F.col("o_orderdate").cast("timestamp").alias("kickoff_at"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        F.col("c_nationkey").alias("home_team_id"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away_team_id"),
        F.when(finished, "finished").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("postponed").alias("status"),
        F.when(finished, (key % 5).cast("int")).alias("home_score"),
        F.when(finished, (F.floor(key / 5) % 4).cast("int")).alias("away_score"),
    )


#: Rows of the ledger that one task holds.
LEDGER_ROWS = 250_000


def by_match(items: DataFrame) -> DataFrame:
    """The ledger's rows dealt by match, in parts that follow their number.

    Parts sized by their bytes in the shuffle hold millions of rows, which a task's sorts and sums by
    player and match make many times larger. Few rows are left to adaptive execution.
    """
    parts = items.count() // LEDGER_ROWS
    return items.repartition(parts, "l_orderkey") if parts > items.sparkSession.sparkContext.defaultParallelism else items


#: What a duel of the ledger was.
DUELS = ["tackle", "interception", "clearance", "save", "aerial"]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Match events in order: sequence, day, minute, player, team, type, subtype, outcome, card, goals, place, family."""
    m = matches(spark, path).select("match_id", "day", "home_team_id", "away_team_id")
    kind = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "shot").when(F.col("l_linestatus") == "F", "foul").otherwise("duel")
    part = F.col("l_partkey")
    subtype = F.when(kind == "pass", F.when(part % 13 == 0, "assist").when(part % 13 == 1, "key_pass").otherwise("simple")).when(kind == "shot", F.when(part % 17 == 0, "penalty").otherwise("open_play"))
    subtype = subtype.when(kind == "foul", "foul").otherwise(F.element_at(F.array(*[F.lit(x) for x in DUELS]), (part % len(DUELS) + 1).cast("int")))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    unlocated = (F.col("l_partkey") + F.col("l_linenumber")) % 11 == 0
    rows = by_match(table(spark, path, "lineitem")).withColumn("sequence", F.row_number().over(order).cast("int"))
    return rows.join(m, F.col("l_orderkey") == F.col("match_id")).select(
        "match_id",
        "day",
        "sequence",
        (1 + F.col("l_partkey") % 90).cast("int").alias("minute"),
        F.col("l_suppkey").alias("player_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
        "home_team_id",
        "away_team_id",
        kind.alias("event_type"),
        subtype.alias("subtype"),
        F.when((kind == "foul") & (part % 41 == 0), "red").when((kind == "foul") & (part % 6 == 0), "yellow").alias("card"),
        F.when(F.col("l_linestatus") == "F", "success").otherwise("fail").alias("outcome"),
        F.expr("l_returnflag = 'N' and l_linestatus = 'F' and l_partkey % 5 = 0").alias("is_goal"),
        F.expr("l_returnflag = 'R' and l_linestatus = 'O' and l_partkey % 31 = 0").alias("is_own_goal"),
        F.when(~unlocated, F.expr("((l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31337) % 10501) / 100.0D")).alias("x_m"),
        F.when(~unlocated, F.col("l_quantity") * 68 / 50).alias("y_m"),
        F.when(F.col("l_orderkey") % 3 == 0, "wyscout_figshare").when(F.col("l_orderkey") % 3 == 1, "espn").otherwise("openligadb").alias("source_family"),
    )


#: The same shapes for the SQL side.
SQL_MATCHES = """
matches as (
  select o.o_orderkey as match_id, n.n_regionkey as competition_id, cast(year(o.o_orderdate) as int) as season,
    o.o_orderdate as kickoff_at, cast(date_diff('day', date '1970-01-01', cast(o.o_orderdate as date)) as bigint) as day,
    c.c_nationkey as home_team_id, cast((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 as int) as away_team_id,
    case o.o_orderstatus when 'F' then 'finished' when 'O' then 'scheduled' else 'postponed' end as status,
    case when o.o_orderstatus = 'F' then cast(o.o_orderkey % 5 as int) end as home_score,
    case when o.o_orderstatus = 'F' then cast(cast(floor(o.o_orderkey / 5) as bigint) % 4 as int) end as away_score
  from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey)"""
SQL_TEAM_MATCH = """
team_match as (
  select match_id, competition_id, season, day, home_team_id as team_id, away_team_id as opponent_id, true as is_home, home_score as gf, away_score as ga,
    case when home_score > away_score then 3 when home_score = away_score then 1 else 0 end as points from matches where status = 'finished'
  union all
  select match_id, competition_id, season, day, away_team_id, home_team_id, false, away_score, home_score,
    case when away_score > home_score then 3 when home_score = away_score then 1 else 0 end from matches where status = 'finished')"""
SQL_LEDGER = f"""
ledger as (
  select l.l_orderkey as match_id, m.day,
    cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as int) as sequence,
    cast(1 + l.l_partkey % 90 as int) as minute, l.l_suppkey as player_id,
    case when l.l_suppkey % 2 = 0 then m.home_team_id else m.away_team_id end as team_id, m.home_team_id, m.away_team_id,
    case l.l_returnflag when 'A' then 'pass' when 'N' then 'shot' else case l.l_linestatus when 'F' then 'foul' else 'duel' end end as event_type,
    case l.l_returnflag when 'A' then case l.l_partkey % 13 when 0 then 'assist' when 1 then 'key_pass' else 'simple' end when 'N' then case when l.l_partkey % 17 = 0 then 'penalty' else 'open_play' end
      else case when l.l_linestatus = 'F' then 'foul' else {DUELS}[l.l_partkey % {len(DUELS)} + 1] end end as subtype,
    case when l.l_returnflag not in ('A', 'N') and l.l_linestatus = 'F' then case when l.l_partkey % 41 = 0 then 'red' when l.l_partkey % 6 = 0 then 'yellow' end end as card,
    case when l.l_linestatus = 'F' then 'success' else 'fail' end as outcome,
    l.l_returnflag = 'N' and l.l_linestatus = 'F' and l.l_partkey % 5 = 0 as is_goal,
    l.l_returnflag = 'R' and l.l_linestatus = 'O' and l.l_partkey % 31 = 0 as is_own_goal,
    case when (l.l_partkey + l.l_linenumber) % 11 = 0 then null else ((l.l_partkey * 7919 + l.l_suppkey * 104729 + l.l_linenumber * 31337) % 10501) / 100.0e0 end as x_m,
    case when (l.l_partkey + l.l_linenumber) % 11 = 0 then null else l.l_quantity * 68 / 50 end as y_m,
    case l.l_orderkey % 3 when 0 then 'wyscout_figshare' when 1 then 'espn' else 'openligadb' end as source_family
  from lineitem l join matches m on l.l_orderkey = m.match_id)"""


def sql(body: str, *shapes: str) -> str:
    """SQL over the shaped tables."""
    return ("with" + ",".join(shapes) + "\n" if shapes else "") + body

"""Queries of crosswalks, guards and smaller statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crosschecks as k
from ..operators import ledger as g
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from .models import STRENGTH, judged

c = F.col
S = lambda body: sql(body, M, TM)
DAY = 10227


def crosswalk(s, d):
    return table(s, d, "customer").select((c("c_nationkey") % 3).cast("string").alias("provider"), c("c_name").alias("external_id"), (c("c_custkey") % 700).alias("canonical_id"))


CROSSWALK = "(select cast(c_nationkey % 3 as varchar) as provider, c_name as external_id, c_custkey % 700 as canonical_id from customer)"


def people(s, d, shift):
    return table(s, d, "customer").where(f"c_custkey % {shift} <> 0").select(c("c_custkey").alias("id"), F.upper("c_mktsegment").alias("name") if shift == 3 else c("c_mktsegment").alias("name"), (c("c_custkey") % 200).alias("born"))


def stats(s, d):
    e = g.counts(ledger(s, d), ["match_id", "team_id"], {"shots": "event_type = 'shot'", "goals": "is_goal"}, True).withColumn("basis", F.lit("derived"))
    other = e.where("match_id % 4 = 0").withColumn("value", c("value") + 1).withColumn("basis", F.lit("source"))
    return k.preferred(e.unionByName(other))


def parts(s, d):
    m = matches(s, d)
    share = lambda n: F.count_if(c("match_id") % n != 0)
    return k.coverage_tier(m.groupBy("competition_id", "season").agg(F.count("*").alias("n"), F.count("home_team_id").alias("with_teams"), share(12).alias("with_lineups"), share(10).alias("with_stats"), share(4).alias("with_events")))


def lists(s, d):
    both = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"), F.array_sort(F.collect_set((c("l_partkey") % 7 + 1).cast("int"))).alias("b"))
    return both.select("l_orderkey", k.zip_agrees(c("a"), c("b")).alias("agrees"))


def observed_record(s, d):
    """A player's matches and goals; summed by match first, where the ledger's rows are, so no match is counted twice."""
    keys = ["competition_id", "season", "team_id", "player_id"]
    seen = ledger(s, d).join(matches(s, d).select("match_id", "competition_id", "season"), "match_id").groupBy("match_id", *keys).agg(F.max(c("source_family") == "wyscout_figshare").alias("detailed"), F.count_if("is_goal").alias("goals"))
    return seen.groupBy(*keys).agg(F.when(F.max("detailed"), F.count("*")).alias("appearances"), F.sum("goals").alias("goals"))


def orders(s, d):
    return table(s, d, "orders")


QUERIES = {
    "jn6_crosswalk": (
        lambda s, d: k.resolved(table(s, d, "customer").select(F.lit("1").alias("provider"), c("c_name").alias("external_id")), crosswalk(s, d)),
        f"select '1' as provider, a.c_name as external_id, w.canonical_id from customer a left join {CROSSWALK} w on w.provider = '1' and w.external_id = a.c_name",
    ),
    "ag30_id19_several_ids": (lambda s, d: k.several_ids(crosswalk(s, d)), f"select provider, canonical_id, count(*) as n from {CROSSWALK} group by all having count(*) > 1"),
    "jn17_id7_same_person": (
        lambda s, d: k.same_person(people(s, d, 2), people(s, d, 3)),
        """with a as (select c_custkey as a_id, lower(c_mktsegment) as n, c_custkey % 200 as born from customer where c_custkey % 2 <> 0), b as (select c_custkey as b_id, lower(c_mktsegment) as n, c_custkey % 200 as born from customer where c_custkey % 3 <> 0)
select a_id, b_id, count(*) over (partition by a_id) = 1 and count(*) over (partition by b_id) = 1 as "unique" from a join b using (n, born)""",
    ),
    "ag19_preferred_stats": (
        stats,
        sql("""select match_id, team_id, stat_key, case when match_id % 4 = 0 then value + 1 else value end as value, match_id % 4 = 0 as from_source from (
  select match_id, team_id, 'shots' as stat_key, count(*) filter (where event_type = 'shot') as value from ledger group by all union all select match_id, team_id, 'goals', count(*) filter (where is_goal) from ledger group by all)""", M, L),  # fmt: skip
    ),
    "ag26_coverage_tier": (
        parts,
        S("""select *, case when with_teams < 0.9 * n then 'results' when with_lineups < 0.9 * n then 'match' when with_stats < 0.9 * n then 'lineup' when with_events < 0.9 * n then 'stats' else 'events' end as tier from (select competition_id, season, count(*) as n, count(home_team_id) as with_teams,
  count(*) filter (where match_id % 12 <> 0) as with_lineups, count(*) filter (where match_id % 10 <> 0) as with_stats, count(*) filter (where match_id % 4 <> 0) as with_events from matches group by all)"""),
    ),
    "jn18_zip_agrees": (
        lists,
        "select l_orderkey, list_sort(list_distinct(list(l_linenumber))) = list_sort(list_distinct(list(cast(l_partkey % 7 + 1 as int)))) as agrees from lineitem group by all",
    ),
    "jn15_membership": (
        lambda s, d: k.members(ledger(s, d), "match_id", "player_id", 7),
        sql("select match_id, count(distinct player_id) as n from ledger group by all having bool_or(player_id = 7)", M, L),
    ),
    "wn7_scoring_streak": (
        lambda s, d: k.streak_up_to_last(ledger(s, d).groupBy("player_id", "day", "match_id").agg(F.max("is_goal").alias("scored")), "player_id", ["day", "match_id"], c("scored")),
        sql("select player_id, cast(coalesce(min(k) filter (where not scored) - 1, max(k)) as bigint) as streak from (select player_id, match_id, bool_or(is_goal) as scored, row_number() over (partition by player_id order by day desc, match_id desc) as k from ledger group by player_id, day, match_id) group by all", M, L),
    ),
    "wn11_starts_in_a_row": (
        lambda s, d: k.streak_up_to_last(ledger(s, d).groupBy("player_id", "day", "match_id").agg((F.min("sequence") <= 3).alias("started")), "player_id", ["day", "match_id"], c("started")),
        sql("select player_id, cast(coalesce(min(k) filter (where not started) - 1, max(k)) as bigint) as streak from (select player_id, match_id, min(sequence) <= 3 as started, row_number() over (partition by player_id order by day desc, match_id desc) as k from ledger group by player_id, day, match_id) group by all", M, L),
    ),
    "wn16_record_numbers": (
        lambda s, d: orders(s, d).select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")).alias("number")),
        "select o_orderkey, cast(row_number() over (partition by o_orderpriority order by o_orderkey) as int) as number from orders",
    ),
    "ag11_reasons": (lambda s, d: orders(s, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "select o_orderstatus, o_orderpriority, count(*) as n from orders group by all"),
    "ag13_lead_times": (
        lambda s, d: k.lead_times(table(s, d, "lineitem").join(orders(s, d).select(c("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey"), F.datediff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date")).cast("long"), "o_orderpriority"),
        """select o_orderpriority, min(h) as least, max(h) filter (where k = floor((n - 1) / 2)) as median, max(h) as most from (select *, row_number() over (partition by o_orderpriority order by h) - 1 as k, count(*) over (partition by o_orderpriority) as n from (
  select o_orderpriority, cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as bigint) as h from lineitem join orders on l_orderkey = o_orderkey)) group by all""",
    ),
    "ml29_spearman": (
        lambda s, d: k.spearman(orders(s, d).select("o_orderpriority", F.floor(c("o_totalprice") / 1000).alias("x"), (c("o_custkey") % 100).alias("y")), "x", "y", "o_orderpriority"),
        """select o_orderpriority, floor(corr(rx, ry) * 1e6 + 0.5) / 1e6 as rho from (select o_orderpriority, rank() over (partition by o_orderpriority order by x) + (count(*) over (partition by o_orderpriority, x) - 1) / 2 as rx, rank() over (partition by o_orderpriority order by y) + (count(*) over (partition by o_orderpriority, y) - 1) / 2 as ry
  from (select o_orderpriority, floor(o_totalprice / 1000) as x, o_custkey % 100 as y from orders)) group by all""",
    ),
    "ml25_input_hash": (
        lambda s, d: k.input_hash(matches(s, d).where("status = 'finished'"), "competition_id", "day", ["match_id"], ["match_id", "home_team_id", "away_team_id", "home_score", "away_score"]),
        S("""select competition_id, sha256(string_agg(h, chr(10) order by day)) as hash, cast(sum(k) as bigint) as n from (select competition_id, day, count(*) as k,
  sha256(string_agg(match_id || '|' || home_team_id || '|' || away_team_id || '|' || home_score || '|' || away_score, chr(10) order by match_id)) as h from matches where status = 'finished' group by all) group by all"""),
    ),
    "ml15_confident_accuracy": (
        lambda s, d: k.confident_accuracy(judged(s, d).select(c("match_id").alias("id"), F.expr("floor(home * 1e6 + 0.5) / 1e6").alias("p"), (c("y") == 0).alias("hit")), [0.1, 0.2]),
        sql("select share, count(*) as n, floor(avg((y = 0)::int) * 1e6 + 0.5) / 1e6 as accuracy from (select cast(unnest([0.1, 0.2]) as double) as share, y, k, n from (select y, row_number() over (order by floor(home * 1e6 + 0.5) / 1e6 desc, match_id) as k, count(*) over () as n from judged)) where k <= floor(n * share) group by all", M, TM, STRENGTH),
    ),
    "ag28_allocated": (
        lambda s, d: k.allocated(table(s, d, "supplier").select(c("s_suppkey").alias("id"), (c("s_nationkey") % 4).cast("int").alias("tier"), (c("s_suppkey") % 5).alias("floor_want"), (c("s_suppkey") % 17).alias("want")), 500),
        """select id, tier, cast(floor_want + least(extra, greatest(500 - floors - before, 0)) as bigint) as granted from (select *, coalesce(sum(extra) over (order by tier, id rows between unbounded preceding and 1 preceding), 0) as before, sum(floor_want) over () as floors from (
  select s_suppkey as id, cast(s_nationkey % 4 as int) as tier, s_suppkey % 5 as floor_want, greatest(s_suppkey % 17 - s_suppkey % 5, 0) as extra from supplier))""",
    ),
    "tx16_xt22_activity": (
        lambda s, d: k.activity(matches(s, d), DAY),
        S(f"""select *, case when today > 0 then 'live' when soon > 0 then 'soon' when fortnight > 0 then 'active' else 'idle' end as state from (select competition_id, count(*) filter (where day = {DAY}) as today, count(*) filter (where day between {DAY + 1} and {DAY + 3}) as soon,
  count(*) filter (where day between {DAY - 14} and {DAY + 14}) as fortnight from matches group by all)"""),
    ),
    "xt4_xt5_upcoming": (
        lambda s, d: matches(s, d).where((c("status") == "scheduled") & c("day").between(DAY, DAY + 7)).orderBy("day", "match_id").limit(60).select("match_id", "competition_id", "day"),
        S(f"select match_id, competition_id, day from matches where status = 'scheduled' and day between {DAY} and {DAY + 7} order by day, match_id limit 60"),
    ),
    "str2_active_set": (
        lambda s, d: table(s, d, "events").where("ts between timestamp '2024-01-15 00:00:00' - interval 150 minutes and timestamp '2024-01-15 00:00:00' + interval 10 minutes").select("event_id", "user_id"),
        "select event_id, user_id from events where ts between timestamp '2024-01-15 00:00:00' - interval 150 minutes and timestamp '2024-01-15 00:00:00' + interval 10 minutes",
    ),
    "ag17_observed_record": (
        observed_record,
        sql("select competition_id, season, team_id, player_id, case when bool_or(source_family = 'wyscout_figshare') then count(distinct match_id) end as appearances, count(*) filter (where is_goal) as goals from ledger join matches using (match_id) group by all", M, L),
    ),
}

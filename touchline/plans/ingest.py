"""Queries of ingest and identity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as i
from ..operators import ingest as g
from ..operators import results as r
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from .results import SUMS

S = lambda body, *more: sql(body, M, TM, *more)
FIELDS = ["status", "home_score", "away_score"]


def incoming(s, d):
    """A second read: some scores corrected, some matches new (those the first read leaves out)."""
    return matches(s, d).withColumn("home_score", F.when(F.col("match_id") % 97 == 0, F.col("home_score") + 1).otherwise(F.col("home_score")))


def stored(s, d):
    return matches(s, d).where("match_id % 53 <> 0")


INCOMING = """
incoming as (select * replace (case when match_id % 97 = 0 then home_score + 1 else home_score end as home_score) from matches)"""
SAME = "i.status is not distinct from m.status and i.home_score is not distinct from m.home_score and i.away_score is not distinct from m.away_score"


def attempts(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("match_id"), (F.col("l_linenumber") % 3).cast("int").alias("component"), (F.col("l_quantity") >= 50).alias("complete"))


def lanes(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("lane"), F.col("event_id").alias("at"), (F.col("value") > 100).alias("ok"))


def snapshots(s, d):
    e = ledger(s, d)
    key = e.select("match_id", F.col("player_id").alias("event_key"), "sequence").groupBy("match_id", "event_key").agg(F.min("sequence").alias("place"))
    again = key.where("(match_id * 31 + event_key) % 5 <> 0 and not (match_id % 40 = 0 and event_key % 3 <> 0)").withColumn("place", F.when(F.col("match_id") % 7 == 0, F.col("place") + 1).otherwise(F.col("place")))
    return g.reconcile(key, again, "match_id", "event_key", "place")


def proof(s, d):
    keys = ["competition_id", "season"]
    m = matches(s, d)
    mine = m.select(*keys, "day", F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"))
    theirs = m.where("match_id % 3 <> 0").select(*keys, (F.col("day") + F.col("match_id") % 2).alias("day"), (F.col("home_team_id") + 100).alias("home"), (F.col("away_team_id") + 100).alias("away"))
    return i.fixture_proof(mine, theirs, ("competition_id", "season"))


PROOF = """,
mine as (select competition_id, season, 0 as side, home_team_id as team, day from matches union all select competition_id, season, 1, away_team_id, day from matches),
theirs as (select competition_id, season, 0 as side, home_team_id + 100 as team, day + match_id % 2 as day from matches where match_id % 3 <> 0 union all select competition_id, season, 1, away_team_id + 100, day + match_id % 2 from matches where match_id % 3 <> 0),
total as (select competition_id, season, team, count(distinct (side, day)) as fixtures from theirs group by all),
cover as (select competition_id, season, t.team, m.team as candidate, count(distinct (t.side, t.day)) as covered from theirs t join mine m using (competition_id, season, side) where abs(t.day - m.day) <= 1 group by all),
full_ as (select competition_id, season, c.team, candidate, fixtures, count(*) over (partition by competition_id, season, candidate) as claims from cover c join total using (competition_id, season, team) where covered = fixtures),
one as (select competition_id, season, team, count(*) as candidates, min(candidate) as candidate, max(claims) as claims from full_ group by all)
select competition_id, season, cast(team as int) as provider_team, fixtures, coalesce(candidates, 0) as candidates, case when verdict = 'proven' then candidate end as canonical_team, verdict from (select *,
  case when candidates is null then 'contradicted' when fixtures < 3 then 'thin' when candidates > 1 or claims > 1 then 'ambiguous' else 'proven' end as verdict from total left join one using (competition_id, season, team))"""


def votes(s, d):
    goals = ledger(s, d).where("is_goal").select("match_id", "team_id", "minute", "player_id")
    theirs = goals.select("match_id", "team_id", (F.col("minute") + F.col("match_id") % 3).cast("int").alias("their_minute"), (F.col("player_id") + 5000).alias("scorer"))
    return i.minute_votes(goals, theirs)


def attach(s, d):
    m = matches(s, d)
    listings = m.where("match_id % 5 = 0").select((F.col("match_id") + 1_000_000).alias("listing_id"), "home_team_id", "away_team_id", (F.col("day") + F.col("match_id") % 7 - 2).alias("listed_day"))
    return i.tolerant_attach(listings, m.select("match_id", "home_team_id", "away_team_id", "day"), ["home_team_id", "away_team_id"])


def standings(s, d):
    rows = r.team_match(matches(s, d))
    table_ = r.league_table(rows)
    source = table_.withColumn("points", F.when((F.col("season") == 1997) & (F.col("team_id") == 3), F.col("points") - 3).otherwise(F.col("points")))
    return i.verified(table_, source, ["competition_id", "season"])


def knockout(s, d):
    m = matches(s, d).where("status = 'finished' and home_score <> away_score")
    return i.feeders(m.withColumn("winner", F.when(F.col("home_score") > F.col("away_score"), F.col("home_team_id")).otherwise(F.col("away_team_id"))), "season")


def reports(s, d):
    e = table(s, d, "events")
    return i.queue(e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("reason"), F.col("event_id").alias("at")))


QUERIES = {
    "ing1_diff_upsert": (
        lambda s, d: g.classified(stored(s, d), incoming(s, d), ["match_id"], FIELDS).groupBy("action").agg(F.count("*").alias("n"), F.sum("match_id").alias("ids")),
        S(f"select case when m.match_id is null then 'insert' when {SAME} then 'same' else 'update' end as action, count(*) as n, cast(sum(i.match_id) as bigint) as ids from incoming i left join (select * from matches where match_id % 53 <> 0) m using (match_id) group by all", INCOMING),
    ),
    "ing2_change_ledger": (
        lambda s, d: g.diff_upsert(stored(s, d), incoming(s, d), ["match_id"], FIELDS).changes,
        S("select i.match_id, 'home_score' as field, cast(m.home_score as varchar) as old_value, cast(i.home_score as varchar) as new_value from incoming i join matches m using (match_id) where m.match_id % 53 <> 0 and i.home_score is distinct from m.home_score", INCOMING),
    ),
    "ing3_duplicate_keys": (lambda s, d: g.duplicates(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"), "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1"),
    "ing5_second_run_writes_nothing": (
        lambda s, d: g.classified(g.merged(stored(s, d), incoming(s, d), ["match_id"]), incoming(s, d), ["match_id"], FIELDS).groupBy("action").agg(F.count("*").alias("n")),
        S("select 'same' as action, count(*) as n from matches"),
    ),
    "ing6_merged": (lambda s, d: g.merged(stored(s, d).where("match_id % 2 = 0"), incoming(s, d).where("match_id % 3 = 0"), ["match_id"]).select("match_id", "home_score"), S("select match_id, home_score from incoming where match_id % 3 = 0 union all select match_id, home_score from matches where match_id % 53 <> 0 and match_id % 2 = 0 and match_id % 3 <> 0", INCOMING)),
    "ing12_best_listing": (
        lambda s, d: g.best_listing(matches(s, d)),
        S("""select match_id, home_team_id, away_team_id, n - 1 as others from (select *, row_number() over (partition by home_team_id, away_team_id order by (status = 'finished') desc, day desc, match_id desc) as k,
  count(*) over (partition by home_team_id, away_team_id) as n from matches) where k = 1"""),
    ),
    "ing13_reconcile": (
        snapshots,
        S("""select match_id, count(*) filter (where gone) as gone, cast(0 as bigint) as added, count(*) filter (where not gone and match_id % 7 = 0) as moved, count(*) as n_stored, count(*) filter (where gone) > 0.5 * count(*) as held
  from (select match_id, player_id, (match_id * 31 + player_id) % 5 = 0 or (match_id % 40 = 0 and player_id % 3 <> 0) as gone from ledger group by all) group by all""", L),  # fmt: skip
    ),
    "ing14_enrichment": (
        lambda s, d: g.enrichment(attempts(s, d)),
        """select match_id, component, attempts, status, case when status = 'pending' then cast(least(1440, 30 * pow(2.0, attempts - 1)) as bigint) end as retry_in from (select *, case when complete then 'complete' when attempts >= 8 then 'exhausted' else 'pending' end as status
  from (select l_orderkey % 500 as match_id, cast(l_linenumber % 3 as int) as component, count(*) as attempts, bool_or(l_quantity >= 50) as complete from lineitem group by all))""",
    ),
    "ing17_agreement": (
        lambda s, d: g.agreement(matches(s, d), incoming(s, d), "match_id", ["home_score", "away_score"]),
        S("select 'home_score' as field, count(*) as compared, count(*) filter (where match_id % 97 <> 0) as equal from matches where home_score is not null union all select 'away_score', count(*), count(*) from matches where away_score is not null"),
    ),
    "ing19_lane_state": (
        lambda s, d: g.lane_state(lanes(s, d)),
        """select lane, runs, failures, case when failures = 0 then 'ok' when failures < 3 then 'degraded' else 'blocked' end as health, case when failures > 0 then cast(least(360, 5 * pow(2.0, failures - 1)) as bigint) else 0 end as wait from (
  select event_type as lane, count(*) as runs, cast(coalesce(min(k) filter (where value > 100) - 1, max(k)) as bigint) as failures from (select *, row_number() over (partition by event_type order by event_id desc) as k from events) group by all)""",
    ),
    "id1_id2_jn13_fixture_proof": (proof, "with" + M + PROOF),
    "id3_jn8_minute_votes": (
        votes,
        sql("""select scorer, count(*) as votes, count(distinct player_id) as named, case when count(distinct player_id) = 1 then min(player_id) end as player_id from (
  select t.match_id, t.team_id, t.their_minute, t.scorer, count(distinct o.player_id) as n, min(o.player_id) as player_id from
    (select match_id, team_id, minute + match_id % 3 as their_minute, player_id + 5000 as scorer from ledger where is_goal) t join (select * from ledger where is_goal) o on t.match_id = o.match_id and t.team_id = o.team_id
    and case when their_minute = 45 then o.minute between 44 and 52 when their_minute >= 90 then o.minute >= 89 else abs(o.minute - their_minute) <= 2 end group by all) where n = 1 group by all""", M, L),  # fmt: skip
    ),
    "id6_queue": (reports, "select user_id as entity, arg_min(event_type, event_id) as first_reason, array_to_string(list_sort(list_distinct(list(event_type))), ',') as reasons, count(*) as reports from events group by all"),
    "id10_feeders": (
        knockout,
        sql("""select match_id, feeder_a, feeder_b from (select match_id, count(*) filter (where fed % 2 = 1) as won, min(fed // 2 % 100000000) as feeder_a, max(fed // 2 % 100000000) as feeder_b from (
  select match_id, max((day * 100000000 + match_id) * 2 + (winner = team_id)::int) over (partition by season, team_id order by day range between unbounded preceding and 1 preceding) as fed
    from (select match_id, season, day, unnest([home_team_id, away_team_id]) as team_id, case when home_score > away_score then home_team_id else away_team_id end as winner
    from matches where status = 'finished' and home_score <> away_score)) group by all) where won = 2 and feeder_a <> feeder_b""", M),  # fmt: skip
    ),
    "id11_standings": (
        standings,
        S(f"""select competition_id, season, count(*) filter (where season = 1997 and team_id = 3) as different, cast(0 as bigint) as repeated_ranks, count(*) as n_teams, count(*) filter (where season = 1997 and team_id = 3) = 0 as verified
  from (select competition_id, season, team_id, {SUMS} from team_match group by all) group by all"""),
    ),
    "id12_acceptance": (
        lambda s, d: i.acceptance(matches(s, d)),
        sql("""select competition_id, season, "check", coalesce(failures, 0) as failures, coalesce(failures, 0) = 0 as passed from (select distinct competition_id, season from matches) cross join (select unnest(['scores present', 'scores in range', 'two different teams', 'season fits the day', 'kickoff present', 'teams present', 'day fits the kickoff', 'unique ids', 'one listing per pair and day', 'one match per pair', 'one competition per team', 'balanced', 'four teams or more', 'as many matches at home as away', 'any match']) as "check") left join (
  select competition_id, season, 'scores present' as "check", count(*) filter (where home_score is null or away_score is null) as failures from f group by all
  union all select competition_id, season, 'scores in range' as "check", count(*) filter (where home_score not between 0 and 30 or away_score not between 0 and 30) as failures from f group by all
  union all select competition_id, season, 'two different teams' as "check", count(*) filter (where home_team_id = away_team_id) as failures from f group by all
  union all select competition_id, season, 'season fits the day' as "check", count(*) filter (where season <> year(kickoff_at)) as failures from f group by all
  union all select competition_id, season, 'kickoff present' as "check", count(*) filter (where kickoff_at is null) as failures from f group by all
  union all select competition_id, season, 'teams present' as "check", count(*) filter (where home_team_id is null or away_team_id is null) as failures from f group by all
  union all select competition_id, season, 'day fits the kickoff' as "check", count(*) filter (where day <> date_diff('day', date '1970-01-01', cast(kickoff_at as date))) as failures from f group by all
  union all select competition_id, season, 'unique ids', count(distinct match_id) from (select *, count(*) over (partition by match_id) as k from f) where k > 1 group by all
  union all select competition_id, season, 'one listing per pair and day', count(distinct (home_team_id, away_team_id, day)) from (select *, count(*) over (partition by home_team_id, away_team_id, day) as k from f) where k > 1 group by all
  union all select competition_id, season, 'one match per pair', count(distinct (home_team_id, away_team_id)) from (select *, count(*) over (partition by competition_id, season, home_team_id, away_team_id) as k from f) where k > 1 group by all
  union all select competition_id, season, 'one competition per team', count(*) from (select *, count(*) over (partition by season, team) as k from t) where k > 1 group by all
  union all select competition_id, season, 'balanced', cast(max(n) > min(n) as bigint) from t group by all union all select competition_id, season, 'four teams or more', cast(count(*) < 4 as bigint) from t group by all
  union all select competition_id, season, 'as many matches at home as away', cast(max(abs(2 * h - n)) > 1 as bigint) from t group by all
  union all select competition_id, season, 'any match', cast(count(*) filter (where status = 'finished') = 0 as bigint) from matches group by all) using (competition_id, season, "check")""", M, """
f as (select * from matches where status = 'finished'), t as (select competition_id, season, team, count(*) as n, sum(h) as h from (select competition_id, season, home_team_id as team, 1 as h from f union all select competition_id, season, away_team_id, 0 from f) group by all)"""),
    ),
    "jn7_near_days": (
        lambda s, d: i.near_days(matches(s, d).where("season = 1995").select("match_id", "home_team_id", F.col("day").alias("day_a")), matches(s, d).where("season = 1995").select(F.col("match_id").alias("other_id"), "home_team_id", F.col("day").alias("day_b")), ["home_team_id"], "day_a", "day_b").where("match_id < other_id").select("match_id", "other_id", "home_team_id"),
        S("select a.match_id, b.match_id as other_id, a.home_team_id from matches a join matches b on a.home_team_id = b.home_team_id and abs(a.day - b.day) <= 1 and a.match_id < b.match_id where a.season = 1995 and b.season = 1995"),
    ),
    "jn10_latest_win_before": (
        lambda s, d: i.latest_before(r.team_match(matches(s, d))),
        S("select match_id, team_id, day, max(case when points = 3 then day * 100000000 + match_id end) over (partition by team_id order by day range between unbounded preceding and 1 preceding) % 100000000 as last_win from team_match"),
    ),
    "jn12_tolerant_attach": (
        attach,
        S("""select listing_id, count(m.match_id) as candidates, case when count(m.match_id) = 1 then min(m.match_id) end as match_id, case count(m.match_id) when 0 then 'missing' when 1 then 'attached' else 'ambiguous' end as state
  from (select match_id + 1000000 as listing_id, home_team_id, away_team_id, day + match_id % 7 - 2 as listed_day from matches where match_id % 5 = 0) l
  left join matches m on l.home_team_id = m.home_team_id and l.away_team_id = m.away_team_id and abs(l.listed_day - m.day) <= 3 group by all"""),
    ),
}

"""Queries of column rules, guards and state policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as x
from ..operators import ledger as g
from ..operators import quality as q
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from .models import STRENGTH, judged

c = F.col
NOW = 10227
S = lambda body: sql(body, M, TM)
NOTE = "A-C: title; D: qualified; G-V: relegated"


def due(s, d):
    """Unsettled components whose retry is due, by match."""
    a = table(s, d, "lineitem").select((c("l_orderkey") % 500).alias("match_id"), c("l_linenumber").alias("component"), (c("l_partkey") % 10).alias("attempts"), (c("l_suppkey") % 60).alias("due_in"))
    ready = a.where("attempts < 8 and due_in <= 10").groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("component")), lambda v: v.cast("string")), ",").alias("components"), F.count("*").alias("n"))
    return ready


def rolling(s, d):
    """Brier scores of the last 30 and 100 forecasts of a season; missing where there are fewer."""
    j = judged(s, d).join(matches(s, d).select("match_id", "day"), "match_id")
    brier = (c("home") - F.expr("cast(y = 0 as int)")) ** 2
    ranked = j.select("season", brier.alias("b"), F.row_number().over(Window.partitionBy("season").orderBy(F.desc("day"), F.desc("match_id"))).alias("k"), F.count("*").over(Window.partitionBy("season")).alias("n"))
    last = lambda m: F.expr(f"floor(case when max(n) >= {m} then avg(case when k <= {m} then b end) end * 1e6 + 0.5) / 1e6").alias(f"last_{m}")
    return ranked.groupBy("season").agg(last(30), last(100))


def goal_sequences(s, d):
    """Matches whose told running totals, goal by goal, are those that the goals themselves give; some are told one goal short."""
    r = g.running_score(ledger(s, d))
    told = c("home_score") + c("away_score") - F.when((c("match_id") % 13 == 0) & (c("minute") > 60), 1).otherwise(0)
    return g.sequences_agree(r.withColumn("told", told))


#: Licences as picture files tell them; a part's key picks one of each.
PICTURES = {
    "name": ["CC BY-SA 4.0", "CC BY 2.0", "CC BY-NC 4.0", "CC BY-ND 2.0", "CC0", "Public domain", "GFDL", "FAL", "Fair use", None, "CC BY-NC-SA 3.0", "cc by 3.0 de"],
    "code": ["cc-by-sa-4.0", "cc-by-2.0", "cc-by-nc-4.0", "cc0", "pd-old", "", None, "gfdl"],
    "url": ["https://licence.example/1", "", None],
    "author": ["A. Author", "", None, "B. Author", "C. Author"],
}
PICTURES_AT = {"name": 1, "code": 7, "url": 3, "author": 11}
CLOCK = "1998-01-01 14:30:00"


def pictured(what):
    values = PICTURES[what]
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.floor(c("p_partkey") / PICTURES_AT[what]) % len(values)).cast("int"))


def coded(s, d):
    """Line items as events of the ledger files: codes, and tags by their numbers."""
    tags = F.array(*[F.when(c("l_suppkey") % k == 0, t) for k, t in zip((7, 2, 3, 5, 4, 6, 9), x.TAGS.values())])
    return table(s, d, "lineitem").select(x.event_kind(c("l_linenumber"), c("l_partkey") % 105).alias("kind"), F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


_kind = lambda k: "{'type': '" + k[0] + "', 'subtype': '" + k[1] + "', 'set_piece': " + (f"'{k[2]}'" if len(k) > 2 else "null") + "}"
CODED = f"""(select case {" ".join(f"when l_partkey % 105 = {n} then {_kind(k)}" for n, k in x.SUB_EVENTS.items())} {" ".join(f"when l_linenumber = {n} then {_kind(k)}" for n, k in x.EVENTS.items())} end as kind,
  list_filter([{", ".join(f"case when l_suppkey % {k} = 0 then {t} end" for k, t in zip((7, 2, 3, 5, 4, 6, 9), x.TAGS.values()))}], lambda v: v is not null) as tags from lineitem)"""

QUERIES = {
    "fn1_predicates": (
        lambda s, d: table(s, d, "orders").where(~c("o_orderstatus").eqNullSafe("F") & (c("o_custkey") <= 500) & c("o_orderpriority").isin("1-URGENT", "5-LOW") & c("o_totalprice").isNotNull()).select("o_orderkey"),
        "select o_orderkey from orders where o_orderstatus is distinct from 'F' and o_custkey <= 500 and o_orderpriority in ('1-URGENT', '5-LOW') and o_totalprice is not null",
    ),
    "fn11_event_kinds": (
        lambda s, d: coded(s, d).groupBy("kind.type", "kind.subtype", "kind.set_piece").agg(F.count("*").alias("n")),
        f"select kind.type as type, kind.subtype as subtype, kind.set_piece as set_piece, count(*) as n from {CODED} group by all",
    ),
    "fn12_outcomes": (
        lambda s, d: coded(s, d).groupBy(c("kind.type").alias("type"), x.outcome(c("kind.type"), c("tags")).alias("outcome")).agg(F.count("*").alias("n")),
        f"""select type, case when type = 'shot' and list_contains(tags, 101) then 'goal' when type = 'duel' then case when list_contains(tags, 703) then 'won' when list_contains(tags, 701) then 'lost' when list_contains(tags, 702) then 'neutral' end
  when list_contains(tags, 1801) then case when type = 'shot' then 'on_target' else 'success' end when list_contains(tags, 1802) then case when type <> 'shot' or type is null then 'fail' when list_contains(tags, 2101) then 'blocked' else 'off_target' end end as outcome, count(*) as n
  from (select kind.type as type, tags from {CODED}) group by all""",
    ),
    "fn16_match_states": (
        lambda s, d: matches(s, d).select(x.match_state(c("status"), c("kickoff_at") + F.expr("make_interval(0, 0, 0, 0, match_id % 24)"), F.lit(f"{CLOCK}").cast("timestamp")).alias("state")).groupBy("state").agg(F.count("*").alias("n")),
        S(f"""select case when status in ('finished', 'postponed') then status when k > t then 'scheduled' when date_diff('minute', k, t) < 180 then 'live' else 'unknown' end as state, count(*) as n from (
  select status, cast(kickoff_at as timestamp) + to_hours(cast(match_id % 24 as int)) as k, timestamp '{CLOCK}' as t from matches) group by all"""),
    ),
    "fn18_fn19_stages": (
        lambda s, d: table(s, d, "part").select("p_partkey", x.stage_role(F.concat("p_type", F.when(c("p_size") > 40, " Play-Off").otherwise(""))).alias("role"), x.stage_key(c("p_type")).alias("key")),
        "select p_partkey, case when p_size > 40 then 'playoff' when regexp_matches(lower(p_type), 'play-?off|final|relegation') then 'playoff' when regexp_matches(lower(p_type), 'friendly|test') then 'excluded' else 'league' end as role, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as key from part",
    ),
    "fn21_beneficiaries": (
        lambda s, d: ledger(s, d).where("is_goal or is_own_goal").groupBy(x.beneficiary(c("is_own_goal"), c("team_id"), c("home_team_id"), c("away_team_id"), c("source_family")).alias("team")).agg(F.count("*").alias("n")),
        sql("select case when is_own_goal and source_family = 'wyscout_figshare' then case when team_id = home_team_id then away_team_id else home_team_id end else team_id end as team, count(*) as n from ledger where is_goal or is_own_goal group by all", M, L),
    ),
    "fn22_search": (lambda s, d: table(s, d, "nation").where(x.names_match(c("n_name"), "ION_1")).select("n_nationkey", "n_name"), "select n_nationkey, n_name from nation where contains(lower(n_name), 'ion_1')"),
    "fn23_titles": (
        lambda s, d: table(s, d, "documents").where(x.phrase_in(c("text"), F.lit("of the"))).select("doc_id"),
        "select doc_id from documents where contains(' ' || trim(regexp_replace(lower(translate(text, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿßÆæ', 'aaaaaaceeeeiiiinooooouuuuyaaaaaaceeeeiiiinooooouuuuyysaa')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ')",
    ),
    "fn24_zone_notes": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", x.zone_note(F.lit(NOTE), F.char(65 + c("n_nationkey"))).alias("zone")),
        "select n_nationkey, case when n_nationkey < 3 then 'title' when n_nationkey = 3 then 'qualified' when n_nationkey between 6 and 21 then 'relegated' end as zone from nation",
    ),
    "fn34_licences": (
        lambda s, d: table(s, d, "part").select("p_partkey", x.licence(*[pictured(k) for k in ("name", "code", "url", "author")], c("p_partkey") % 29 == 0, c("p_partkey") % 4 == 0).alias("licence")),
        f"""select p_partkey, case when p_partkey % 29 = 0 then 'rejected' when contains(lower(code), '-nc') or contains(lower(code), '-nd') or regexp_matches(lower(name), '\\b(nc|nd)\\b') then 'restricted'
  when starts_with(lower(code), 'cc0') or starts_with(lower(code), 'pd') or contains(lower(name), 'public domain') or starts_with(lower(name), 'cc0') or regexp_matches(lower(code), '^cc-by(-sa)?-[0-9]') or regexp_matches(lower(name), '^cc by(-sa)? [0-9]')
  then case when (regexp_matches(lower(code), '^cc-by(-sa)?-[0-9]') or regexp_matches(lower(name), '^cc by(-sa)? [0-9]')) and (author = '' or url = '') then 'review_required' when p_partkey % 4 = 0 and not starts_with(lower(code), 'pd') and not contains(lower(name), 'public domain') then 'review_required' else 'approved' end
  else 'review_required' end as licence from (select p_partkey, {", ".join(f"coalesce({[v for v in PICTURES[k]]}[p_partkey // {PICTURES_AT[k]} % {len(PICTURES[k])} + 1], '') as {k}" for k in PICTURES).replace("None", "null")} from part)""",
    ),
    "ing15_due_retries": (
        due,
        "select match_id, array_to_string(list_sort(list_distinct(list(component))), ',') as components, count(*) as n from (select l_orderkey % 500 as match_id, l_linenumber as component from lineitem where l_partkey % 10 < 8 and l_suppkey % 60 <= 10) group by all",
    ),
    "so5_distinct": (lambda s, d: matches(s, d).select("competition_id", "season").distinct(), S("select distinct competition_id, season from matches")),
    "tk1_nulls_last": (
        lambda s, d: matches(s, d).orderBy(c("home_score").desc_nulls_last(), c("away_score").asc_nulls_last(), "match_id").limit(100).select("match_id", "home_score"),
        S("select match_id, home_score from matches order by home_score desc nulls last, away_score asc nulls last, match_id limit 100"),
    ),
    "wn18_rolling_metrics": (
        rolling,
        sql("select season, floor(case when max(n) >= 30 then avg(b) filter (where k <= 30) end * 1e6 + 0.5) / 1e6 as last_30, floor(case when max(n) >= 100 then avg(b) filter (where k <= 100) end * 1e6 + 0.5) / 1e6 as last_100 from (select season, pow(home - (y = 0)::int, 2) as b, row_number() over (partition by season order by day desc, match_id desc) as k, count(*) over (partition by season) as n from judged join (select match_id, day from matches) using (match_id)) group by all", M, TM, STRENGTH),
    ),
    "tx12_goal_sequences": (
        goal_sequences,
        sql("""select match_id, count(*) as goals, not bool_or(told <> so_far) as consistent from (select *, row_number() over (partition by match_id order by sequence) as so_far,
  row_number() over (partition by match_id order by sequence) - case when match_id % 13 = 0 and minute > 60 then 1 else 0 end as told from ledger where is_goal or is_own_goal) group by all""", M, L),
    ),
    "dq3_dq6_uniqueness": (
        lambda s, d: matches(s, d).groupBy("home_team_id", "away_team_id", "day").agg(F.count("*").alias("n")).where("n > 1"),
        S("select home_team_id, away_team_id, day, count(*) as n from matches group by all having count(*) > 1"),
    ),
    "dq4_implications": (
        lambda s, d: q.summary(matches(s, d), {"scores iff finished": "(status = 'finished') = (home_score is not null)", "both scores or none": "(home_score is null) = (away_score is null)"}),
        S("select rule, broken, broken = 0 as passed from (select 'scores iff finished' as rule, count(*) filter (where (status = 'finished') <> (home_score is not null)) as broken from matches union all select 'both scores or none', count(*) filter (where (home_score is null) <> (away_score is null)) from matches)"),
    ),
    "xt9_located_shots": (lambda s, d: ledger(s, d).where("event_type = 'shot' and x_m is not null").select("match_id", "sequence", "x_m", "y_m", "is_goal"), sql("select match_id, sequence, x_m, y_m, is_goal from ledger where event_type = 'shot' and x_m is not null", M, L)),
}

"""Queries of stories, evidence and the record's windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..operators import ledger as g
from ..operators import models as m
from ..operators import newsroom as n
from ..operators import profiles as p
from ..operators import results as r
from ..operators import text as t
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql
from . import assembly, profiles, text
from .ledger import MINUTES
from .models import STRENGTH, forecasts, judged

c = F.col
NOW = 10215
WINDOW = 60
#: Profiles of the competitions: leagues with a table have all angles, those without zones no zone moves, cups those of the match alone.
MATCH_ANGLES = ["comeback_from_ht", "multi_goal_scorer", "high_scoring", "heavy_margin"]
TABLE_ANGLES = ["leader_change", "upset", "winning_streak", "unbeaten_run_ended"]
ZONE_ANGLES = ["title_race_swing", "top4_entry_exit", "relegation_zone_move"]
ALLOWED = {0: MATCH_ANGLES + TABLE_ANGLES + ZONE_ANGLES, 1: MATCH_ANGLES + TABLE_ANGLES + ZONE_ANGLES, 2: MATCH_ANGLES + TABLE_ANGLES, 3: MATCH_ANGLES, 4: MATCH_ANGLES}


def profiled(s, d):
    allowed = s.createDataFrame([(k, x) for k, of in ALLOWED.items() for x in of], "competition_id int, angle string")
    done, scorers = text.finished_halves(s, d), text.scorers(s, d)
    return n.profiled(t.match_angles(done, r.team_match(matches(s, d)), scorers).join(matches(s, d).select("match_id", "competition_id"), "match_id"), allowed)


def appearances(s, d):
    e = ledger(s, d)
    played = g.minutes(e).where("minutes > 0").select("match_id", "player_id").distinct()
    goals = e.groupBy("match_id", "player_id").agg(F.count_if("is_goal").alias("goals"))
    return played.join(goals, ["match_id", "player_id"]).join(matches(s, d).select("match_id", "competition_id", "season", "day"), "match_id")


def evidence(s, d):
    return n.evidence(assembly.QUERIES["pr15_match_assembly"][0](s, d), profiles.loads(s, d), text.material(s, d))


def windows(s, d):
    rows = m.graded(m.picks(forecasts(s, d)), matches(s, d)).join(matches(s, d).select("match_id", "day"), "match_id")
    return n.record_windows(rows)


def upset_auc(s, d):
    j = judged(s, d).select("y", *[half_up(c(x), 6).alias(x) for x in ("home", "draw", "away")])
    most = F.greatest("home", "draw", "away")
    said = F.when(c("home") == most, 0).when(c("draw") == most, 1).otherwise(2)
    rows = j.select(half_up(1 - most, 6).alias("doubt"), (said != c("y")).alias("wrong"))
    return m.area_under_curve(rows, c("doubt"), c("wrong")).select("positives", "negatives", half_up(c("auc"), 6).alias("auc"))


_runs = {k: f"coalesce(min(k) filter (where points not in ({', '.join(map(str, of))})), count(*) + 1) - 1 as {k}" for k, (of, _) in n.TRENDS.items()}
_told = " union all ".join(f"select competition_id, season, team_id, '{k}' as kind, {k} as run, case when {k} >= {least + 2} then 1.4e0 else 1.0e0 end as score from runs where last >= {NOW - WINDOW} and {k} >= {least}{' and ' + k + ' > ' + n.STRICTER[k] if k in n.STRICTER else ''}" for k, (_, least) in n.TRENDS.items())
_fact = {"result": "home_score || '-' || away_score", "goals": "nullif(timeline, '')", "shots": "case when n_events > 0 then home_shots || '-' || away_shots end", "on_target": "case when n_events > 0 then home_on_target || '-' || away_on_target end", "lineup": "nullif(lineup, '')", "busiest": "cast(busiest as varchar)", "loads": "cast(floor(h.load * 100 + 0.5) as bigint) || '-' || cast(floor(w.load * 100 + 0.5) as bigint)", "angles": "nullif(angles, '')"}
_of = lambda module, name: f"({module.QUERIES[name][1]})"
_allowed = " or ".join(f"(competition_id = {k} and angle in ({', '.join(repr(x) for x in of)}))" for k, of in ALLOWED.items())
_weights = "case angle " + " ".join(f"when '{k}' then {w}" for k, w in t.ANGLES.items()) + " end"

QUERIES = {
    "tx2_profiled_angles": (
        profiled,
        f"""with {M.strip()}, {L.strip()}, hat as (select match_id, count(*) as tricks from (select match_id, player_id from ledger where is_goal group by all having count(*) >= 3) group by all),
each as (select match_id, competition_id, unnest(string_split(angles, ',')) as angle, generate_subscripts(string_split(angles, ','), 1) as place from {_of(text, "tx1_materiality")} join matches using (match_id))
select match_id, competition_id, angles, score, score >= 1.0 as material from (select match_id, competition_id, coalesce(string_agg(angle, ',' order by place) filter (where ok), '') as angles, floor((coalesce(sum({_weights}::double) filter (where ok), 0.0e0) + 0.6e0 * coalesce(any_value(tricks), 0)) * 100 + 0.5) / 100 as score
  from (select *, {_allowed} as ok from each) left join hat using (match_id) group by all)""",
    ),
    "tx3_detected_stories": (
        lambda s, d: n.stories_of(matches(s, d), r.team_match(matches(s, d)), appearances(s, d), NOW, WINDOW),
        "with" + M + "," + TM + "," + L + "," + MINUTES + f""",
runs as (select competition_id, season, team_id, max(day) as last, {", ".join(_runs.values())} from (select *, row_number() over (partition by competition_id, season, team_id order by day desc, match_id desc) as k from team_match where day <= {NOW}) group by all),
apps as (select competition_id, season, player_id, match_id, matches.day, count(*) filter (where is_goal) as goals from ledger join matches using (match_id) where (match_id, player_id) in (select (match_id, player_id) from minutes where minutes > 0) group by all),
form as (select competition_id, season, player_id, max(day) as last, coalesce(min(k) filter (where goals = 0), count(*) + 1) - 1 as run from (select *, row_number() over (partition by competition_id, season, player_id order by day desc, match_id desc) as k from apps where day <= {NOW}) group by all),
watch as (select competition_id, season, count(*) filter (where status = 'finished') as run, max(day) filter (where status = 'finished') as last, count(*) filter (where status <> 'finished' and day = {NOW}) as open from matches where day between {NOW - WINDOW} and {NOW} group by all)
select 'team_trend' as story, competition_id, season, cast(team_id as bigint) as subject, kind, run, score from ({_told})
union all select 'player_form', competition_id, season, player_id, 'scoring_run', run, floor((1.0e0 + (run - 3) * 0.2e0) * 100 + 0.5) / 100 from form where last >= {NOW - WINDOW} and run >= 3
union all select 'table_watch', competition_id, season, competition_id, strftime(date '1970-01-01' + cast(last as int), '%G-W%V'), run, 1.0e0 from watch where run >= 6 and open = 0""",
    ),
    "tx7_evidence": (
        evidence,
        f"""select match_id, cast(len(lines) as int) as n_facts, missing, case when len(lines) = {len(_fact)} then 'full' when contains(missing, 'shots') then 'result' else 'events' end as depth, sha256(match_id || chr(10) || array_to_string(lines, chr(10))) as packet_hash from (
  select match_id, list_filter([{", ".join(f"'{k}=' || {v}" for k, v in _fact.items())}], lambda x: x is not null) as lines, concat_ws(',', {", ".join(f"case when {v} is null then '{k}' end" for k, v in _fact.items())}) as missing
  from {_of(assembly, "pr15_match_assembly")} a left join {_of(profiles, "pr5_pr6_ag31_team_load")} h on h.match_id = a.match_id and h.team_id = a.home_team_id left join {_of(profiles, "pr5_pr6_ag31_team_load")} w on w.match_id = a.match_id and w.team_id = a.away_team_id
  left join {_of(text, "tx1_materiality")} t on t.match_id = a.match_id where status = 'finished')""".replace("  select match_id, list_filter", "  select a.match_id, list_filter"),
    ),
    "ag24_record_windows": (
        windows,
        sql("""select last, count(*) as picks, count(*) filter (where grade = 'won') as won, count(*) filter (where grade = 'lost') as lost, count(*) filter (where grade = 'void') as void, floor(count(*) filter (where grade = 'won') / nullif(count(*) filter (where grade in ('won', 'lost')), 0)::double * 1e4 + 0.5) / 1e4 as hit_rate,
  floor(sum(probability) filter (where grade in ('won', 'lost')) * 1e4 + 0.5) / 1e4 as expected from (select g.*, row_number() over (order by m.day desc, match_id desc) as k from graded g join matches m using (match_id) where grade <> 'pending'), (select unnest([30, 60, 100]) as last) where k <= last group by all""", M, TM, STRENGTH),  # fmt: skip
    ),
    "ml15_upset_auc": (
        upset_auc,
        sql("""select p as positives, q as negatives, floor((s - p * (p + 1) / 2) / (p * q) * 1e6 + 0.5) / 1e6 as auc from (select count(*) filter (where wrong) as p, count(*) filter (where not wrong) as q, sum(rank) filter (where wrong) as s from (
  select wrong, rank() over (order by doubt) + (count(*) over (partition by doubt) - 1) / 2 as rank from (select floor((1 - greatest(home, draw, away)) * 1e6 + 0.5) / 1e6 as doubt, case when home >= draw and home >= away then 0 when draw >= away then 1 else 2 end <> y as wrong
  from (select y, floor(home * 1e6 + 0.5) / 1e6 as home, floor(draw * 1e6 + 0.5) / 1e6 as draw, floor(away * 1e6 + 0.5) / 1e6 as away from judged))))""", M, TM, STRENGTH),  # fmt: skip
    ),
}

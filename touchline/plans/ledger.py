"""Queries over the event ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as g
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import ledger, matches, sql

GOALS = """
goals as (select *, case when is_own_goal then team_id <> home_team_id else team_id = home_team_id end as home from ledger where is_goal or is_own_goal)"""
S = lambda body: sql(body, M, L, GOALS)


def _stats_sql(stats: dict[str, str], keys: str, zeros: bool) -> str:
    wide = ", ".join(f"count(*) filter (where {p}) as {k}" for k, p in stats.items())
    return f"select {keys}, stat_key, value from (unpivot (select {keys}, {wide} from ledger group by all) on {', '.join(stats)} into name stat_key value value)" + ("" if zeros else " where value > 0")


MINUTES = """
minutes as (select match_id, team_id, player_id, first <= 3 as is_starter, cast(greatest(0, least(90, coalesce(dismissed, 90)) - case when first <= 3 then 0 else entered end) as bigint) as minutes from (
  select match_id, team_id, player_id, min(sequence) as first, min(minute) as entered, min(minute) filter (where card = 'red') as dismissed from ledger group by all))"""
PHASE = "case when minute <= 15 then '01-15' when minute <= 30 then '16-30' when minute <= 45 then '31-45' when minute <= 60 then '46-60' when minute <= 75 then '61-75' else '76-90' end"
INSIDE = "count(*) filter (where x_m >= 88.5 and abs(y_m - 34.0) <= 20.16)"
ratio = lambda a, b: f"floor({a} * 1.0e0 / nullif({b}, 0) * 1e4 + 0.5) / 1e4"


def profiles(s, d):
    e = ledger(s, d)
    return g.player_profile(e, g.minutes(e))


_names = ["goals", "assists", "key_passes", "shots", "shots_on_target", "passes", "completed"]
_r2 = lambda a, b: f"floor(({a}) * 1.0e0 / nullif({b}, 0) * 1e2 + 0.5) / 1e2"
_rates = {
    "start_rate": ("starts", "appearances"), "minutes_per_appearance": ("minutes", "appearances"), "goals_per90": ("goals", "(minutes / 90.0e0)"), "assists_per90": ("assists", "(minutes / 90.0e0)"), "goal_contributions_per90": ("goals + assists", "(minutes / 90.0e0)"),
    "shots_per90": ("shots", "(minutes / 90.0e0)"), "shots_on_target_rate": ("shots_on_target", "shots"), "goals_per_shot": ("goals", "shots"), "key_passes_per90": ("key_passes", "(minutes / 90.0e0)"), "cards_per90": ("cards", "(minutes / 90.0e0)"), "pass_accuracy": ("completed", "passes"),
}
PROFILE = f"""select *, {", ".join(f"{_r2(*v)} as {k}" for k, v in _rates.items())} from (select player_id, count(*) as appearances, count(*) filter (where is_starter) as starts, count(*) filter (where not is_starter) as sub_appearances, cast(sum(minutes) as bigint) as minutes,
  {", ".join(f"cast(sum({k}) as bigint) as {k}" for k in [*_names, "cards"])}, count(*) filter (where home) as home_appearances, cast(coalesce(sum(goals) filter (where home), 0) as bigint) as home_goals, count(*) filter (where not home) as away_appearances,
  cast(coalesce(sum(goals) filter (where not home), 0) as bigint) as away_goals, count(*) filter (where k <= 5) as last_appearances, cast(coalesce(sum(goals) filter (where k <= 5), 0) as bigint) as last_goals, cast(coalesce(sum(shots) filter (where k <= 5), 0) as bigint) as last_shots
  from (select a.*, row_number() over (partition by a.player_id order by a.day desc, a.match_id desc) as k, mi.is_starter, mi.minutes from (select match_id, player_id, max(day) as day, bool_or(team_id = home_team_id) as home, sum(case card when 'red' then 2 when 'yellow' then 1 else 0 end) as cards,
    {", ".join(f"count(*) filter (where {g.IMPACT[k]}) as {k}" for k in _names)} from ledger group by match_id, player_id) a join minutes mi using (match_id, player_id)) group by player_id)"""
_lowered = lambda m: f"-{m}" if m == "cards_per90" else m
_share = lambda m: f"case when {m} is not null and minutes >= {g.LEAST_MINUTES} then cast(floor((rank() over (partition by minutes >= {g.LEAST_MINUTES} order by {_lowered(m)}) - 1 + 0.5 * (count(*) over (partition by minutes >= {g.LEAST_MINUTES}, {m}) - 1)) / (count({m}) over (partition by minutes >= {g.LEAST_MINUTES}) - 1) * 100 + 0.5) as bigint) end as p_{m}"


def profiles_placed(s, d):
    return g.with_percentiles(profiles(s, d), ["player_id"], g.PLAYER_METRICS, ("cards_per90",), F.col("minutes") >= g.LEAST_MINUTES)


QUERIES = {
    "src7_event_sequence": (lambda s, d: ledger(s, d).select("match_id", "sequence", "minute", "player_id", "team_id", "event_type"), S("select match_id, sequence, minute, player_id, team_id, event_type from ledger")),
    "ag5_team_stats": (lambda s, d: g.counts(ledger(s, d), ["match_id", "team_id"], g.TEAM_STATS, True), S(_stats_sql(g.TEAM_STATS, "match_id, team_id", True))),
    "ag6_player_stats": (lambda s, d: g.counts(ledger(s, d), ["match_id", "player_id"], g.PLAYER_STATS, False), S(_stats_sql(g.PLAYER_STATS, "match_id, player_id", False))),
    "ag7_minutes": (lambda s, d: g.minutes(ledger(s, d)), sql("select * from minutes", M, L, MINUTES)),
    "ag8_distinct_counts": (
        lambda s, d: ledger(s, d).groupBy("team_id").agg(F.count_distinct("player_id").alias("players"), F.count_distinct("match_id").alias("n_matches"), F.count_distinct("event_type").alias("kinds")),
        S("select team_id, count(distinct player_id) as players, count(distinct match_id) as n_matches, count(distinct event_type) as kinds from ledger group by all"),
    ),
    "ag14_tk3_key_performers": (
        lambda s, d: g.key_performers(ledger(s, d)),
        S(f"""select * from (select *, cast(row_number() over (partition by team_id order by goals desc, shots_on_target desc, passes_completed desc, duels_won desc, player_id) as int) as place from (
  select team_id, player_id, {", ".join(f"count(*) filter (where {g.TEAM_STATS[k]}) as {k}" for k in ("goals", "shots_on_target", "passes_completed", "duels_won"))} from ledger group by all)) where place <= 4"""),
    ),
    "ag16_pr3_player_profile": (profiles_placed, sql(f"select *, {', '.join(_share(m) for m in g.PLAYER_METRICS)} from ({PROFILE})", M, L, MINUTES)),
    "ag20_player_impact": (
        lambda s, d: g.impact(ledger(s, d)),
        sql(f"select * from (select match_id, player_id, {', '.join(f'count(*) filter (where {p}) as n_{k}' for k, p in g.IMPACT.items())}, count(*) as n_events from ledger group by all) join (select match_id, player_id, is_starter, minutes from minutes) using (match_id, player_id)", M, L, MINUTES),
    ),
    "ag21_phases": (
        lambda s, d: g.phases(ledger(s, d)),
        S(f"""select * from (select match_id, {PHASE} as phase, case when team_id = home_team_id then 'home' else 'away' end as side, count(*) filter (where event_type = 'shot') as shots,
  count(*) filter (where event_type = 'shot' and outcome = 'success') as on_target, count(*) filter (where is_goal) as goals from ledger group by all) where shots > 0 or goals > 0"""),
    ),
    "ag22_shot_profile": (
        lambda s, d: g.shot_profile(ledger(s, d)),
        S(f"""select team_id, count(*) as shots, count(*) filter (where is_goal) as goals, count(x_m) as located, {INSIDE} as inside, {ratio("count(*) filter (where is_goal)", "count(*)")} as conversion, {ratio(INSIDE, "count(x_m)")} as inside_share,
  floor(avg(sqrt((105.0 - x_m) * (105.0 - x_m) + (34.0 - y_m) * (34.0 - y_m))) * 100 + 0.5) / 100 as mean_distance from ledger where event_type = 'shot' group by all"""),
    ),
    "ag27_missing_fields": (
        lambda s, d: g.missing_fields(ledger(s, d)),
        S("select source_family, count(*) as shots, count(x_m) as with_place, count(player_id) as with_player, count(minute) as with_minute, count(*) filter (where x_m is null) as without_place from ledger where event_type = 'shot' group by all"),
    ),
    "ag29_first_scorer": (lambda s, d: g.first_scorer(ledger(s, d)), S("select match_id, arg_min(player_id, sequence) as player_id, arg_min(minute, sequence) as minute, arg_min(is_own_goal, sequence) as is_own_goal, arg_min(home, sequence) as home from goals group by all")),
    "ing20_score_check": (
        lambda s, d: g.score_check(ledger(s, d), matches(s, d)),
        S("""select *, home_score = home_goals and away_score = away_goals as agrees from (select match_id, home_score, away_score, (select count(*) from goals g where g.match_id = m.match_id and home) as home_goals,
  (select count(*) from goals g where g.match_id = m.match_id and not home) as away_goals from matches m where status = 'finished')"""),
    ),
    "jn9_assists": (
        lambda s, d: g.assists(ledger(s, d)),
        S("""select g.match_id, g.sequence as goal_at, g.player_id as scorer, max(p.sequence) as pass_at, arg_max(p.player_id, p.sequence) as assist from ledger g join ledger p on g.match_id = p.match_id and g.team_id = p.team_id
  and p.sequence between g.sequence - 6 and g.sequence - 1 where g.is_goal and p.event_type = 'pass' and p.outcome = 'success' group by all"""),
    ),
    "wn3_wn4_wn22_running_score": (
        lambda s, d: g.running_score(ledger(s, d)),
        S("""select match_id, sequence, minute, player_id, is_own_goal, count(*) filter (where home) over u as home_score, count(*) filter (where not home) over u as away_score,
  count(*) filter (where home) over b as home_before, count(*) filter (where not home) over b as away_before, minute - lag(minute) over (partition by match_id order by sequence) as since_goal from goals
  window u as (partition by match_id order by sequence rows unbounded preceding), b as (partition by match_id order by sequence rows between unbounded preceding and 1 preceding)"""),
    ),
    "wn13_percentiles": (
        lambda s, d: g.mid_rank_percentile(profiles(s, d).where("minutes >= 450"), "goals_per90").select("player_id", "goals_per90", "percentile"),
        sql(f"""select player_id, goals_per90, cast(floor((rank() over (order by goals_per90) - 1 + 0.5 * (count(*) over (partition by goals_per90) - 1)) / (count(*) over () - 1) * 100 + 0.5) as bigint) as percentile
  from ({PROFILE}) where minutes >= 450""", M, L, MINUTES),  # fmt: skip
    ),
    "wn15_xt7_pulse": (
        lambda s, d: g.pulse(ledger(s, d)),
        S("""select match_id, team_id, sequence, minute, count(*) over (partition by match_id, team_id order by minute range unbounded preceding) as so_far,
  count(*) over (partition by match_id, team_id order by minute range between 10 preceding and current row) as recent from ledger where event_type = 'shot'"""),
    ),
    "wn17_best_family": (
        lambda s, d: g.best_family(ledger(s, d).withColumn("source_family", F.when(F.col("player_id") % 3 == 0, "wyscout_figshare").when(F.col("player_id") % 3 == 1, "espn").otherwise("openligadb"))).groupBy("match_id", "source_family").agg(F.count("*").alias("n")),
        S("""select match_id, family as source_family, count(*) as n from (select *, case player_id % 3 when 0 then 'wyscout_figshare' when 1 then 'espn' else 'openligadb' end as family, player_id % 3 as r,
  min(player_id % 3) over (partition by match_id) as best from ledger) where r = best group by all"""),
    ),
    "wn21_last_pass": (
        lambda s, d: g.last_pass_before(ledger(s, d)),
        S("""select match_id, sequence, player_id, passer from (select *, last_value(case when event_type = 'pass' and outcome = 'success' then player_id end ignore nulls)
  over (partition by match_id, team_id order by sequence rows between unbounded preceding and 1 preceding) as passer from ledger) where is_goal"""),
    ),
    "fn5_thirds": (
        lambda s, d: g.thirds(ledger(s, d)),
        S("select team_id, nullif(count(*) filter (where x_m < 35), 0) as defensive, nullif(count(*) filter (where x_m >= 35 and x_m < 70), 0) as middle, nullif(count(*) filter (where x_m >= 70), 0) as final from ledger where x_m is not null group by all"),
    ),
}

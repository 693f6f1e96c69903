"""Queries over results, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import results as r
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import matches, sql, table, teams


def rows(spark, d):
    return r.team_match(matches(spark, d))


SUMS = """count(*) as played, count(*) filter (where points = 3) as won, count(*) filter (where points = 1) as drawn, count(*) filter (where points = 0) as lost,
  cast(sum(gf) as bigint) as gf, cast(sum(ga) as bigint) as ga, cast(sum(gf - ga) as bigint) as gd, cast(sum(points) as bigint) as points"""


def table_sql(where: str = "", order: str = "points desc, gd desc, gf desc", extra: str = "") -> str:
    return f"""select *, cast(row_number() over (partition by competition_id, season order by {order}, team_id) as int) as position from (
  select competition_id, season, team_id, {SUMS} from team_match {where} group by all){extra}"""


AS_OF = 10227  # 1998-01-01


def coverage(spark, d):
    m = matches(spark, d)
    return m.groupBy("competition_id").agg(
        F.count("*").alias("n_matches"), F.count_if(F.col("status") == "finished").alias("finished"), F.count_if(F.col("status") == "scheduled").alias("scheduled"),
        F.count_if(F.col("home_score").isNull()).alias("without_score"), F.count_distinct("home_team_id").alias("home_teams"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    )


def health(spark, d):
    """Scheduled matches whose day has passed, by competition, as of a day."""
    m = matches(spark, d)
    stale = (F.col("status") == "scheduled") & (F.col("day") < AS_OF)
    return m.groupBy("competition_id").agg(F.count_if(stale).alias("missing_results"), F.max(F.when(stale, AS_OF - F.col("day"))).alias("oldest_days"), F.count_if(F.col("status") == "postponed").alias("postponed"))


def state_counts(spark, d):
    return matches(spark, d).groupingSets([[F.col("competition_id"), F.col("status")], [F.col("competition_id")], []], "competition_id", "status").agg(F.count("*").alias("n")).select("competition_id", "status", "n")


def competition_state(spark, d):
    m = matches(spark, d).groupBy("competition_id", "season").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "finished").alias("done"), F.count_if((F.col("status") == "scheduled") & (F.col("day") >= AS_OF)).alias("ahead"))
    state = F.when(F.col("done") == 0, "upcoming").when(F.col("ahead") == 0, "completed").otherwise("in progress")
    return m.withColumn("state", state)


def decorated(spark, d):
    t = teams(spark, d)
    home = t.select(F.col("team_id").alias("home_team_id"), F.col("name").alias("home_name"), F.col("group_id").alias("home_group"))
    away = t.select(F.col("team_id").alias("away_team_id"), F.col("name").alias("away_name"), F.col("group_id").alias("away_group"))
    m = matches(spark, d).join(home, "home_team_id", "left").join(away, "away_team_id", "left")
    return m.select("match_id", "home_name", "away_name", "status", (F.col("home_group") == F.col("away_group")).alias("same_group"))


def with_events(spark, d):
    """Which matches have events, shots and returned lines."""
    m = matches(spark, d).select("match_id")
    has = lambda where, name: table(spark, d, "lineitem").where(where).select(F.col("l_orderkey").alias("match_id")).distinct().withColumn(name, F.lit(True))
    out = m.join(has("true", "has_events"), "match_id", "left").join(has("l_returnflag = 'N'", "has_shots"), "match_id", "left")
    return out.select("match_id", F.coalesce("has_events", F.lit(False)).alias("has_events"), F.coalesce("has_shots", F.lit(False)).alias("has_shots"))


def paged(spark, d):
    m = matches(spark, d).where("competition_id = 1 and season = 1997")
    return m.orderBy(F.desc("day"), "match_id").offset(20).limit(50).select("match_id", "day")


def latest_season(spark, d):
    m = matches(spark, d).select("competition_id", "season").distinct()
    newest = Window.partitionBy("competition_id").orderBy(F.desc("season"))
    return m.withColumn("k", F.row_number().over(newest)).where("k = 1").select("competition_id", "season")


def team_page(spark, d):
    """A team's last 20 matches, home and away, from one scan."""
    m = matches(spark, d).where("home_team_id = 7 or away_team_id = 7")
    return m.orderBy(F.desc("day"), "match_id").limit(20).select("match_id", "day", (F.col("home_team_id") == 7).alias("is_home"))


def live_first(spark, d):
    """Scheduled first and soonest first, then finished and newest first; 40 rows."""
    group = F.when(F.col("status") == "scheduled", 0).when(F.col("status") == "finished", 1).otherwise(2).alias("grp")
    m = matches(spark, d).where(F.col("day") >= AS_OF).select("match_id", "day", group)
    return m.orderBy("grp", F.when(F.col("grp") == 0, F.col("day")).otherwise(-F.col("day")), "match_id").limit(40)


def ring_buffer(spark, d):
    """Each team's five newest match ids."""
    newest = Window.partitionBy("team_id").orderBy(F.desc("day"), F.desc("match_id"))
    return rows(spark, d).withColumn("k", F.row_number().over(newest)).where("k <= 5").select("team_id", "match_id", "k")


def due_queue(spark, d):
    return matches(spark, d).where(f"status = 'scheduled' and day <= {AS_OF}").orderBy("day", "match_id").limit(30).select("match_id", "day")


def leaders(spark, d):
    """Teams with ten matches or more by goals a match; the first ten."""
    t = r.tally(rows(spark, d), "team_id").where("played >= 10")
    return t.select("team_id", F.expr("floor(gf * 100.0D / played + 0.5) / 100").alias("gf_rate")).orderBy(F.desc("gf_rate"), "team_id").limit(10)


def halves(spark, d):
    m = matches(spark, d).where("season = 1996")
    return m.select(F.col("home_team_id").alias("team_id"), "match_id").unionByName(m.select(F.col("away_team_id").alias("team_id"), "match_id"))


def distinct_first(spark, d):
    """One row per unordered pair of teams: the earliest match."""
    m = matches(spark, d).select(F.least("home_team_id", "away_team_id").alias("team_a"), F.greatest("home_team_id", "away_team_id").alias("team_b"), F.struct("day", "match_id").alias("at"))
    return m.groupBy("team_a", "team_b").agg(F.min("at").alias("at")).select("team_a", "team_b", F.col("at.match_id").alias("match_id"))


def never_met(spark, d):
    """Pairs of teams of one group that never played in 1995."""
    t = teams(spark, d)
    pairs = t.select("group_id", F.col("team_id").alias("team_a")).join(t.select("group_id", F.col("team_id").alias("team_b")), "group_id").where("team_a < team_b").select("team_a", "team_b")
    met = matches(spark, d).where("home_score = 4 and away_score = 3").select(F.least("home_team_id", "away_team_id").alias("team_a"), F.greatest("home_team_id", "away_team_id").alias("team_b"))
    return pairs.join(met, ["team_a", "team_b"], "left_anti")


def in_both(spark, d):
    """Teams that won at home and away on some day of 1997."""
    t = rows(spark, d).where("season = 1997 and points = 3")
    return t.where("is_home").select("team_id").intersect(t.where("not is_home").select("team_id"))


def set_equality(spark, d):
    """Tables of two sources compared by competition and season: teams whose counts differ."""
    mine = r.tally(rows(spark, d), "competition_id", "season", "team_id")
    theirs = r.tally(rows(spark, d).where("match_id % 97 <> 0"), "competition_id", "season", "team_id")
    both = mine.alias("a").join(theirs.alias("b"), ["competition_id", "season", "team_id"], "full")
    same = F.expr("a.points <=> b.points and a.gf <=> b.gf and a.ga <=> b.ga and a.played <=> b.played")
    return both.groupBy("competition_id", "season").agg(F.count_if(~same).alias("different"))


def leader_change(spark, d):
    """Competitions whose first place changed hands on the season's last ten days."""
    t = rows(spark, d)
    last = t.groupBy("competition_id", "season").agg(F.max("day").alias("last_day"))
    t = t.join(last, ["competition_id", "season"])
    first = lambda rows, name: r.league_table(rows).where("position = 1").select("competition_id", "season", F.col("team_id").alias(name))
    return first(t.where("day < last_day - 10"), "before").join(first(t, "after"), ["competition_id", "season"]).withColumn("changed", F.col("before") != F.col("after"))


def rest_difference(spark, d):
    g = r.rest(rows(spark, d)).where("gap is not null")
    home = g.where("is_home").select("match_id", F.col("gap").alias("home_gap"))
    away = g.where("not is_home").select("match_id", F.col("gap").alias("away_gap"))
    return home.join(away, "match_id").withColumn("difference", F.col("home_gap") - F.col("away_gap"))


def freshness(spark, d):
    m = matches(spark, d)
    return m.groupBy("competition_id").agg(F.max("day").alias("newest"), F.max(F.when(F.col("status") == "finished", F.col("day"))).alias("newest_result"))


def history(spark, d):
    """A team's seasons: table line, and whether it finished first."""
    return r.league_table(rows(spark, d)).where("team_id = 3").withColumn("champion", F.col("position") == 1)


def baseline_last_seasons(spark, d):
    """Goals a match over a competition's last three seasons, weighted by matches."""
    m = matches(spark, d).where("status = 'finished'").groupBy("competition_id", "season").agg(F.count("*").alias("n"), F.sum(F.col("home_score") + F.col("away_score")).alias("goals"))
    newest = Window.partitionBy("competition_id").orderBy(F.desc("season"))
    return m.withColumn("k", F.row_number().over(newest)).where("k <= 3").groupBy("competition_id").agg(F.sum("n").alias("n"), F.expr("floor(sum(goals) * 1e4 / sum(n) + 0.5) / 1e4").alias("goal_rate"))


S = lambda body: sql(body, M, TM)
ROLL = "count(*) over (partition by team_id order by day range between {k} preceding and 1 preceding) as last_{k}"
_NEWEST = "row_number() over (partition by team_id order by day desc, match_id desc)"

QUERIES = {
    "league_table": (lambda s, d: r.league_table(rows(s, d)), S(table_sql())),
    "ag1_wn1_league_table": (
        lambda s, d: r.league_table(rows(s, d)).join(r.form(rows(s, d)), ["competition_id", "season", "team_id"]),
        S(f"""select t.*, f.form from ({table_sql()}) t join (
  select competition_id, season, team_id, string_agg(case when points = 3 then 'W' when points = 1 then 'D' else 'L' end, '' order by k) as form from (
    select *, row_number() over (partition by competition_id, season, team_id order by day desc, match_id desc) as k from team_match) where k <= 5 group by all) f using (competition_id, season, team_id)"""),
    ),
    "ag2_table_by_wins": (lambda s, d: r.league_table(rows(s, d), "wins"), S(table_sql(order="points desc, won desc, gd desc, gf desc"))),
    "ag3_table_as_of": (lambda s, d: r.league_table(rows(s, d).where(F.col("day") < AS_OF)), S(table_sql(f"where day < {AS_OF}"))),
    "ag4_results_split": (
        lambda s, d: r.results_split(rows(s, d)),
        S(f"""select *, floor(won * 1.0e0 / played * 1e4 + 0.5) / 1e4 as win_rate, floor(gf * 1.0e0 / played * 1e4 + 0.5) / 1e4 as gf_rate, floor(points * 1.0e0 / played * 1e4 + 0.5) / 1e4 as points_rate from (
  select team_id, venue, {SUMS} from (select *, 'all' as venue from team_match union all select *, case when is_home then 'home' else 'away' end from team_match) group by all)"""),
    ),
    "ag9_coverage": (
        coverage,
        S("""select competition_id, count(*) as n_matches, count(*) filter (where status = 'finished') as finished, count(*) filter (where status = 'scheduled') as scheduled,
  count(*) filter (where home_score is null) as without_score, count(distinct home_team_id) as home_teams, min(season) as first_season, max(season) as last_season from matches group by all"""),
    ),
    "ag10_data_health": (
        health,
        S(f"""select competition_id, count(*) filter (where status = 'scheduled' and day < {AS_OF}) as missing_results, max({AS_OF} - day) filter (where status = 'scheduled' and day < {AS_OF}) as oldest_days,
  count(*) filter (where status = 'postponed') as postponed from matches group by all"""),
    ),
    "ag32_goal_baseline": (
        baseline_last_seasons,
        S("""select competition_id, cast(sum(n) as bigint) as n, floor(sum(goals) * 1e4 / sum(n) + 0.5) / 1e4 as goal_rate from (select *, row_number() over (partition by competition_id order by season desc) as k from (
  select competition_id, season, count(*) as n, sum(home_score + away_score) as goals from matches where status = 'finished' group by all)) where k <= 3 group by all"""),
    ),
    "ag33_freshness": (freshness, S("select competition_id, max(day) as newest, max(day) filter (where status = 'finished') as newest_result from matches group by all")),
    "wn2_form": (
        lambda s, d: r.form(rows(s, d), keys=("team_id",)),
        S(f"select team_id, string_agg(case when points = 3 then 'W' when points = 1 then 'D' else 'L' end, '' order by k) as form from (select *, {_NEWEST} as k from team_match) where k <= 5 group by all"),
    ),
    "wn5_cumulative_points": (
        lambda s, d: r.cumulative(rows(s, d)),
        S("""select competition_id, season, team_id, match_id, count(*) over w as played, cast(sum(points) over w as bigint) as points, cast(sum(gf - ga) over w as bigint) as gd from team_match
  window w as (partition by competition_id, season, team_id order by day, match_id rows unbounded preceding)"""),
    ),
    "wn6_trailing_runs": (
        lambda s, d: r.trailing_runs(rows(s, d), "team_id"),
        S(f"""select team_id, cast(coalesce(min(k) filter (where points <> 3) - 1, max(k)) as bigint) as winning, cast(coalesce(min(k) filter (where points = 0) - 1, max(k)) as bigint) as unbeaten,
  cast(coalesce(min(k) filter (where points <> 0) - 1, max(k)) as bigint) as losing, cast(coalesce(min(k) filter (where points = 3) - 1, max(k)) as bigint) as winless from (select *, {_NEWEST} as k from team_match) group by all"""),
    ),
    "wn8_wn9_rest": (
        lambda s, d: r.rest(rows(s, d)),
        S(f"select match_id, team_id, day, is_home, day - lag(day) over (partition by team_id order by day, match_id) as gap, {ROLL.format(k=7)}, {ROLL.format(k=14)}, {ROLL.format(k=21)} from team_match"),
    ),
    "wn10_venue_switches": (
        lambda s, d: r.venue_switches(rows(s, d)),
        S(f"select team_id, count(*) filter (where is_home <> earlier) as switches from (select *, {_NEWEST} as k, lead(is_home) over (partition by team_id order by day desc, match_id desc) as earlier from team_match) where k < 5 group by all"),
    ),
    "wn19_table_move": (
        lambda s, d: r.table_move(rows(s, d).where("season = 1997"), AS_OF - 60),
        S(f"""select a.competition_id, a.season, a.team_id, a.position as before, a.points as points_before, b.position as after, b.points as points_after, a.position - b.position as moved
  from ({table_sql(f"where season = 1997 and day < {AS_OF - 60}")}) a join ({table_sql(f"where season = 1997 and day <= {AS_OF - 60}")}) b using (competition_id, season, team_id)"""),
    ),
    "wn20_leader_change": (
        leader_change,
        S(f"""select a.competition_id, a.season, a.team_id as before, b.team_id as after, a.team_id <> b.team_id as changed from
  ({table_sql("where day < (select max(x.day) from team_match x where x.competition_id = team_match.competition_id and x.season = team_match.season) - 10")}) a
  join ({table_sql()}) b using (competition_id, season) where a.position = 1 and b.position = 1"""),
    ),
    "tk2_paged": (paged, S("select match_id, day from matches where competition_id = 1 and season = 1997 order by day desc, match_id limit 50 offset 20")),
    "tk4_latest_season": (latest_season, S("select competition_id, max(season) as season from matches group by all")),
    "tk5_team_page": (team_page, S("select match_id, day, home_team_id = 7 as is_home from matches where home_team_id = 7 or away_team_id = 7 order by day desc, match_id limit 20")),
    "tk6_leaders": (leaders, S(f"select team_id, floor(gf * 100.0e0 / played + 0.5) / 100 as gf_rate from (select team_id, {SUMS} from team_match group by all) where played >= 10 order by gf_rate desc, team_id limit 10")),
    "tk8_live_first": (
        live_first,
        S(f"""select match_id, day, case status when 'scheduled' then 0 when 'finished' then 1 else 2 end as grp from matches where day >= {AS_OF}
  order by grp, case when status = 'scheduled' then day else -day end, match_id limit 40"""),
    ),
    "tk9_ring_buffer": (ring_buffer, S(f"select team_id, match_id, cast(k as int) as k from (select *, {_NEWEST} as k from team_match) where k <= 5")),
    "tk10_due_queue": (due_queue, S(f"select match_id, day from matches where status = 'scheduled' and day <= {AS_OF} order by day, match_id limit 30")),
    "so1_halves": (halves, S("select home_team_id as team_id, match_id from matches where season = 1996 union all select away_team_id, match_id from matches where season = 1996")),
    "so2_first_meeting": (distinct_first, S("select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, arg_min(match_id, day * 1000000000 + match_id) as match_id from matches group by all")),
    "so3_jn5_never_met": (
        never_met,
        S("""select a.n_nationkey as team_a, b.n_nationkey as team_b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey
  where not exists (select 1 from matches where home_score = 4 and away_score = 3 and least(home_team_id, away_team_id) = a.n_nationkey and greatest(home_team_id, away_team_id) = b.n_nationkey)"""),
    ),
    "so4_home_and_away_winners": (in_both, S("select team_id from team_match where season = 1997 and points = 3 and is_home intersect select team_id from team_match where season = 1997 and points = 3 and not is_home")),
    "so6_tables_differ": (
        set_equality,
        S(f"""select competition_id, season, count(*) filter (where a.points is distinct from b.points or a.gf is distinct from b.gf or a.ga is distinct from b.ga or a.played is distinct from b.played) as different
  from (select competition_id, season, team_id, {SUMS} from team_match group by all) a full join (select competition_id, season, team_id, {SUMS} from team_match where match_id % 97 <> 0 group by all) b using (competition_id, season, team_id) group by all"""),
    ),
    "jn1_jn2_decorated": (
        decorated,
        S("select match_id, h.n_name as home_name, a.n_name as away_name, status, h.n_regionkey = a.n_regionkey as same_group from matches left join nation h on home_team_id = h.n_nationkey left join nation a on away_team_id = a.n_nationkey"),
    ),
    "jn3_team_rows": (rows, S("select match_id, competition_id, season, day, team_id, opponent_id, is_home, gf, ga, points from team_match")),
    "jn4_intel_flags": (
        with_events,
        S("select match_id, exists (select 1 from lineitem where l_orderkey = match_id) as has_events, exists (select 1 from lineitem where l_orderkey = match_id and l_returnflag = 'N') as has_shots from matches"),
    ),
    "pr13_team_history": (history, S(f"select *, position = 1 as champion from ({table_sql()}) where team_id = 3")),
    "pr16_competition_state": (
        competition_state,
        S(f"""select *, case when done = 0 then 'upcoming' when ahead = 0 then 'completed' else 'in progress' end as state from (select competition_id, season, count(*) as n, count(*) filter (where status = 'finished') as done,
  count(*) filter (where status = 'scheduled' and day >= {AS_OF}) as ahead from matches group by all)"""),
    ),
    "xt1_head_to_head": (
        lambda s, d: r.head_to_head(matches(s, d)),
        S("""select team_a, team_b, count(*) as meetings, count(*) filter (where margin > 0) as a_won, count(*) filter (where margin = 0) as drawn, count(*) filter (where margin < 0) as b_won from (
  select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, case when home_team_id < away_team_id then home_score - away_score else away_score - home_score end as margin,
    row_number() over (partition by least(home_team_id, away_team_id), greatest(home_team_id, away_team_id) order by day desc, match_id desc) as k from matches where status = 'finished') where k <= 12 group by all"""),
    ),
    "xt2_rest_difference": (
        rest_difference,
        S("""select h.match_id, h.gap as home_gap, a.gap as away_gap, h.gap - a.gap as difference from (select *, day - lag(day) over (partition by team_id order by day, match_id) as gap from team_match) h
  join (select *, day - lag(day) over (partition by team_id order by day, match_id) as gap from team_match) a on h.match_id = a.match_id and h.is_home and not a.is_home where h.gap is not null and a.gap is not null"""),
    ),
    "xt11_state_counts": (state_counts, S("select competition_id, status, count(*) as n from matches group by grouping sets ((competition_id, status), (competition_id), ())")),
    "xt21_next_fixture": (
        lambda s, d: r.next_fixture(matches(s, d), AS_OF),
        S(f"""select team_id, arg_min(day, day * 1000000000 + match_id) as day, arg_min(match_id, day * 1000000000 + match_id) as match_id from (
  select home_team_id as team_id, day, match_id from matches where status = 'scheduled' and day > {AS_OF} union all select away_team_id, day, match_id from matches where status = 'scheduled' and day > {AS_OF}) group by all"""),
    ),
}

"""Queries of profiles, sources and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as g
from ..operators import profiles as p
from ..operators import results as r
from ..sources import captures as k
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql, table
from .ledger import MINUTES

c = F.col
S = lambda body: sql(body, M, TM)


def rows(s, d):
    return r.team_match(matches(s, d))


def feed(s, d):
    """The finished matches as a provider's matchday feed in JSON, parsed again."""
    m = matches(s, d).where("status = 'finished'")
    result = lambda kind, name, h, a: F.struct(F.lit(kind).alias("resultTypeID"), F.lit(name).alias("resultName"), h.alias("pointsTeam1"), a.alias("pointsTeam2"))
    body = F.to_json(F.struct(
        c("match_id").alias("matchID"), F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("matchDateTimeUTC"), F.struct(c("home_team_id").alias("teamId")).alias("team1"), F.struct(c("away_team_id").alias("teamId")).alias("team2"),
        F.lit(True).alias("matchIsFinished"), F.array(result(1, "half", F.floor(c("home_score") / 2), F.floor(c("away_score") / 2)), result(2, "end", c("home_score"), c("away_score"))).alias("matchResults"), F.array().cast("array<struct<goalID: long>>").alias("goals"),
    ))
    return k.matchday(m.select(body.alias("body"))).select("match_id", "home", "away", "finished", "home_score", "away_score", "home_ht")


def groups(s, d):
    n = table(s, d, "nation")
    tree = table(s, d, "region").select(c("r_regionkey").cast("int").alias("id"), F.lit(None).cast("int").alias("parent")).unionByName(n.select((c("n_nationkey") + 100).cast("int").alias("id"), c("n_regionkey").cast("int").alias("parent")))
    return k.group_leaves(s, tree).select("id", "root", "level")


UPCOMING = 10227
RECENT = """
numbered as (select *, row_number() over (partition by team_id order by day, match_id) as k from team_match),
placed as (select *, min(k) over (partition by team_id, day) as first_k from numbered),
recent as (select match_id, is_home, case when n >= 3 then a0 end as attack, case when n >= 3 then c0 end as conceded, case when n >= 3 then f0 end as form, a0, c0, f0 from (
  select p.match_id, p.is_home, count(b.k) as n, avg(b.gf) as a0, avg(b.ga) as c0, avg(b.points) as f0 from placed p left join numbered b on b.team_id = p.team_id and b.k between p.first_k - 8 and p.first_k - 1 group by p.match_id, p.is_home)),
edges as (select h.match_id, h.attack - a.attack as ea, a.conceded - h.conceded as ec, h.form - a.form as ef, h.a0 - a.a0 as xa, h.c0 - a.c0 as xc, h.f0 - a.f0 as xf from recent h join recent a on h.match_id = a.match_id and h.is_home and not a.is_home)"""

DURATION = "case when match_id % 23 = 0 then 'penalties' when match_id % 11 = 0 then 'extra_time' else 'regular' end"


def loads(s, d):
    return p.team_load(matches(s, d).withColumn("duration", F.expr(DURATION)))


def team_seasons(s, d):
    """Shots, cards and the first goal from the ledger; possession is told for a third of the matches."""
    e = ledger(s, d)
    cards = F.sum(F.when(c("card") == "red", 2).when(c("card") == "yellow", 1).otherwise(0)).cast("long")
    home = F.max(c("team_id") == c("home_team_id"))
    share = 40 + c("match_id") % 21
    stats = e.groupBy("match_id", "team_id").agg(F.count_if(c("event_type") == "shot").alias("shots"), F.count_if((c("event_type") == "shot") & (c("outcome") == "success")).alias("shots_on_target"), cards.alias("cards"), home.alias("home"))
    stats = stats.withColumn("possession", F.when(c("match_id") % 3 == 0, F.when(c("home"), share).otherwise(100 - share))).drop("home")
    first = g.goals(e).groupBy("match_id").agg(F.min_by("home", "sequence").alias("home"), F.first("home_team_id").alias("h"), F.first("away_team_id").alias("a")).select("match_id", F.when(c("home"), c("h")).otherwise(c("a")).alias("team_id"))
    return g.with_percentiles(p.team_season(rows(s, d), first, stats), ["competition_id", "season", "team_id"], p.TEAM_METRICS, p.LESS_IS_BETTER, F.lit(True), pool=("competition_id", "season"))


_r2 = lambda a, b: f"floor(({a}) * 1.0e0 / nullif({b}, 0) * 1e2 + 0.5) / 1e2"
_season_rates = {
    "points_per_match": ("points", "played"), "goals_for_per_match": ("gf", "played"), "goals_against_per_match": ("ga", "played"), "clean_sheet_rate": ("clean", "played"), "failed_to_score_rate": ("blank", "played"), "scored_first_rate": ("ahead", "ahead + conceded_first"),
    "points_per_match_after_conceding_first": ("behind", "conceded_first"), "shots_per_match": ("shots", "stats_matches"), "shots_against_per_match": ("against", "stats_matches"), "shots_on_target_per_match": ("target", "stats_matches"), "shot_conversion": ("gf", "shots"),
    "possession_avg": ("possession", "1"), "cards_per_match": ("cards", "played"), "home_points_per_match": ("hp", "hm"), "away_points_per_match": ("ap", "am"), "last5_points_per_match": ("lp", "lm"),
}
_placed = lambda m: f"case when {m} is not null then cast(floor((rank() over (partition by competition_id, season order by {'-' if m in p.LESS_IS_BETTER else ''}{m} nulls last) - 1 + 0.5 * (count(*) over (partition by competition_id, season, {m}) - 1)) / nullif(count({m}) over (partition by competition_id, season) - 1, 0) * 100 + 0.5) as bigint) end as p_{m}"
TEAM_SEASON = f"""with st as (select match_id, team_id, count(*) filter (where event_type = 'shot') as shots, count(*) filter (where event_type = 'shot' and outcome = 'success') as target, sum(case card when 'red' then 2 when 'yellow' then 1 else 0 end) as cards,
    case when match_id % 3 = 0 then case when bool_or(team_id = home_team_id) then 40 + match_id % 21 else 60 - match_id % 21 end end as possession from ledger group by match_id, team_id),
fg as (select match_id, arg_min(case when (team_id = home_team_id) <> is_own_goal then home_team_id else away_team_id end, sequence) as first_team from ledger where is_goal or is_own_goal group by all),
x as (select t.*, f.first_team, a.shots, a.target, a.cards, a.possession, b.shots as against, a.shots is not null and b.shots is not null as known, row_number() over (partition by competition_id, season, t.team_id order by day desc, t.match_id desc) as k
  from team_match t left join fg f on f.match_id = t.match_id left join st a on a.match_id = t.match_id and a.team_id = t.team_id left join st b on b.match_id = t.match_id and b.team_id = t.opponent_id),
y as (select competition_id, season, team_id, count(*) as played, cast(sum(points) as bigint) as points, cast(sum(gf) as bigint) as gf, cast(sum(ga) as bigint) as ga, count(*) filter (where ga = 0) as clean, count(*) filter (where gf = 0) as blank, count(*) filter (where first_team = team_id) as ahead,
  count(*) filter (where first_team <> team_id) as conceded_first, coalesce(sum(points) filter (where first_team <> team_id), 0) as behind, count(*) filter (where first_team <> team_id and points = 3) as comebacks, count(*) filter (where known) as stats_matches, coalesce(sum(shots) filter (where known), 0) as shots,
  sum(against) filter (where known) as against, sum(target) filter (where known) as target, avg(possession) filter (where known) as possession, coalesce(sum(cards), 0) as cards, count(*) filter (where is_home) as hm, coalesce(sum(points) filter (where is_home), 0) as hp,
  count(*) filter (where not is_home) as am, coalesce(sum(points) filter (where not is_home), 0) as ap, count(*) filter (where k <= 5) as lm, sum(points) filter (where k <= 5) as lp,
  string_agg(case points when 3 then 'W' when 1 then 'D' else 'L' end, '' order by k) filter (where k <= 10) as form from x group by competition_id, season, team_id)
select competition_id, season, team_id, played, points, gf, ga, comebacks, conceded_first, stats_matches, form, {", ".join(f"{_r2(*v)} as {k}" for k, v in _season_rates.items())} from y"""

_parts = {"congestion": "matches_14", "short_rest": "short_rest", "rest": "coalesce(6 - coalesce(rest_before_next, days_since_last), 0)", "away": "coalesce(away_share, 0)", "switching": "switches"}
_part = {k: f"floor(100 * {w} * least(greatest({_parts[k]} * 1.0e0 / {full}, 0), 1) * 100 + 0.5) / 100" for k, (w, full) in p.FATIGUE.items()}
#: Every (team, day) meets the finished matches before it one by one.
LOAD = f"""
sides as (select match_id, competition_id, day, status, {DURATION} as duration, unnest([home_team_id, away_team_id]) as team_id, unnest([0, 1]) as away from matches),
as_of as (select distinct team_id, day as t from sides),
past as (select a.team_id, t, s.match_id, s.competition_id, s.day, s.away, s.duration, row_number() over (partition by a.team_id, t order by s.day desc, s.match_id desc) as k from as_of a join sides s on a.team_id = s.team_id and s.status = 'finished' and s.day < t),
gaps as (select *, lead(day) over w as before_day, lead(competition_id) over w as before_comp from past window w as (partition by team_id, t order by k)),
seen as (select team_id, t, count(*) filter (where t - day <= 7) as matches_7, count(*) filter (where t - day <= 14) as matches_14, count(*) filter (where t - day <= 21) as matches_21, count(*) filter (where t - before_day <= 21 and day - before_day < 4) as short_rest,
  count(*) filter (where t - day <= 21 and duration <> 'regular') as extra_time, min(t - day) as days_since_last, arg_min(match_id, k) as last_match_id, floor(avg(away) filter (where k <= 5) * 100 + 0.5) / 100 as away_share, count(*) filter (where k <= 4 and competition_id <> before_comp) as switches from gaps group by all),
ahead as (select team_id, t, min({{'day': s.day, 'id': s.match_id}}) as nxt from as_of join sides s using (team_id) where s.status = 'scheduled' and s.day >= t group by all),
measured as (select a.team_id, t as day, coalesce(matches_7, 0) as matches_7, coalesce(matches_14, 0) as matches_14, coalesce(matches_21, 0) as matches_21, coalesce(short_rest, 0) as short_rest, coalesce(extra_time, 0) as extra_time, days_since_last, last_match_id, away_share, coalesce(switches, 0) as switches,
  nxt.id as next_match_id, nxt.day - (t - days_since_last) as rest_before_next from as_of a left join seen using (team_id, t) left join ahead using (team_id, t)),
load as (select match_id, m.*, {", ".join(f"{v} as from_{k}" for k, v in _part.items())}, cast(floor({" + ".join(_part.values())} + 0.5) as bigint) as load from measured m join (select match_id, team_id, day from sides) using (team_id, day))"""

QUERIES = {
    "src1_filtered_scan": (
        lambda s, d: table(s, d, "orders").where("o_orderstatus = 'F' and o_totalprice >= 100000 and o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey is not null").select("o_orderkey", "o_custkey", "o_totalprice"),
        "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 100000 and o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey is not null",
    ),
    "src3_count": (lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("n")), "select count(*) as n from lineitem"),
    "src4_key_lookup": (
        lambda s, d: k.key_lookup(table(s, d, "lineitem"), table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n")),
        "select l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by all",
    ),
    "src8_matchday_feed": (feed, S("select match_id, cast(home_team_id as bigint) as home, cast(away_team_id as bigint) as away, true as finished, home_score, away_score, cast(home_score // 2 as int) as home_ht from matches where status = 'finished'")),
    "src11_group_leaves": (groups, "select cast(n_nationkey + 100 as int) as id, cast(n_regionkey as int) as root, 1 as level from nation"),
    "src15_published_only": (
        lambda s, d: matches(s, d).join(table(s, d, "region").where("r_regionkey < 2").select(c("r_regionkey").alias("competition_id")), "competition_id", "left_semi").groupBy("season").agg(F.count("*").alias("n")),
        S("select season, count(*) as n from matches where competition_id < 2 group by all"),
    ),
    "fn32_json_access": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    ),
    "jn11_as_of_inputs": (
        lambda s, d: (lambda t: t.select("match_id", "team_id", F.sum("gf").over(Window.partitionBy("team_id").orderBy("day").rangeBetween(-365, -1)).cast("long").alias("goals_before")))(rows(s, d)),
        S("select match_id, team_id, cast(sum(gf) over (partition by team_id order by day range between 365 preceding and 1 preceding) as bigint) as goals_before from team_match"),
    ),
    "jn14_same_group": (
        lambda s, d: (lambda n: matches(s, d).join(n.select(c("n_nationkey").alias("home_team_id"), c("n_regionkey").alias("gh")), "home_team_id").join(n.select(c("n_nationkey").alias("away_team_id"), c("n_regionkey").alias("ga")), "away_team_id").where("gh = ga").groupBy("gh").agg(F.count("*").alias("n")))(table(s, d, "nation")),
        S("select h.n_regionkey as gh, count(*) as n from matches join nation h on home_team_id = h.n_nationkey join nation a on away_team_id = a.n_nationkey where h.n_regionkey = a.n_regionkey group by all"),
    ),
    "jn16_lookup_chain": (
        lambda s, d: ledger(s, d).select("player_id", "match_id", "team_id").join(matches(s, d).select("match_id", "competition_id", "season"), "match_id").groupBy("player_id", "competition_id", "season").agg(F.count_distinct("match_id").alias("n_matches"), F.count_distinct("team_id").alias("n_teams")),
        sql("select player_id, competition_id, season, count(distinct match_id) as n_matches, count(distinct team_id) as n_teams from ledger join matches using (match_id) group by all", M, L),
    ),
    "id5_club_windows": (
        lambda s, d: ledger(s, d).join(matches(s, d).select("match_id", "season"), "match_id").groupBy("player_id", "season").agg(F.array_join(F.transform(F.array_sort(F.collect_set("team_id")), lambda x: x.cast("string")), ",").alias("clubs")),
        sql("select player_id, season, array_to_string(list_transform(list_sort(list_distinct(list(team_id))), lambda x: cast(x as varchar)), ',') as clubs from ledger join matches using (match_id) group by all", M, L),
    ),
    "ag15_pr2_team_season": (team_seasons, sql(f"select *, {', '.join(_placed(m) for m in p.TEAM_METRICS)} from ({TEAM_SEASON})", M, TM, L)),
    "pr5_pr6_ag31_team_load": (loads, sql("select * from load", M, LOAD)),
    "pr9_pr10_matchup": (
        lambda s, d: p.matchup(rows(s, d)),
        sql("""select match_id, floor((coalesce(ea * 0.5, 0) + coalesce(ec * 0.3, 0) + coalesce(ef * 0.2, 0)) / nullif(case when ea is null then 0 else 0.5e0 end + case when ec is null then 0 else 0.3e0 end + case when ef is null then 0 else 0.2e0 end, 0) * 1e4 + 0.5) / 1e4 as edge from edges""", M, TM, RECENT),
    ),
    "xt3_top_components": (
        lambda s, d: p.top_components(rows(s, d)),
        sql("""select match_id, component, edge, cast(place as int) as place from (select *, row_number() over (partition by match_id order by abs(edge) desc, component) as place from (select match_id, component, floor(x * 1e6 + 0.5) / 1e6 as edge from (
  select match_id, unnest(['attack', 'conceded', 'form']) as component, unnest([xa, xc, xf]) as x from edges) where x is not null)) where place <= 2""", M, TM, RECENT),  # fmt: skip
    ),
    "wn14_so4_squad_overlap": (
        lambda s, d: p.eleven_overlap(ledger(s, d)),
        sql("""select team_id, match_id, cast(len(list_intersect(squad, before)) as bigint) as shared, cast(len(squad) as bigint) as used from (select *, lag(squad) over (partition by team_id order by day, match_id) as before from (
  select team_id, day, match_id, list_distinct(list(player_id)) as squad from ledger group by all)) where before is not null""", M, L),  # fmt: skip
    ),
    "ag18_minute_share": (
        lambda s, d: p.minute_share(g.minutes(ledger(s, d)), 3),
        sql("select team_id, count(*) as players, floor(sum(m) filter (where k <= 3) * 1.0e0 / sum(m) * 1e4 + 0.5) / 1e4 as share from (select *, row_number() over (partition by team_id order by m desc, player_id) as k from (select team_id, player_id, sum(minutes) as m from minutes group by all)) group by all", M, L, MINUTES),
    ),
    "wn12_collapsed_runs": (
        lambda s, d: p.collapsed_runs(ledger(s, d)),
        sql("select player_id, count(*) filter (where before is null or before <> team_id) as spells from (select *, lag(team_id) over (partition by player_id order by day, match_id, sequence) as before from ledger) group by all", M, L),
    ),
    "wn25_terciles": (
        lambda s, d: p.terciles(table(s, d, "orders"), "o_totalprice", "o_orderpriority"),
        "select o_orderpriority, max(o_totalprice) filter (where k = floor(n / 3.0e0)) as lower, max(o_totalprice) filter (where k = floor(n * (2 / 3.0e0))) as upper from (select *, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as k, count(*) over (partition by o_orderpriority) as n from orders) group by all",
    ),
    "xt15_repeated_fixtures": (
        lambda s, d: matches(s, d).groupBy("home_team_id", "away_team_id", "season").agg(F.count("*").alias("n")).where("n > 1"),
        S("select home_team_id, away_team_id, season, count(*) as n from matches group by all having count(*) > 1"),
    ),
    "ag12_latency_percentiles": (
        lambda s, d: p.nearest_percentiles(table(s, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type", least=5),
        "select event_type, max(value) filter (where k = floor(0.5 * (n - 1) + 0.5)) as p50, max(value) filter (where k = floor(0.95 * (n - 1) + 0.5)) as p95 from (select *, row_number() over (partition by event_type order by value, event_id) - 1 as k, count(*) over (partition by event_type) as n from events) where n >= 5 group by all",
    ),
}

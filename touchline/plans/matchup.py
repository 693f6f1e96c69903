"""Queries of what is known of two sides before a match, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as g
from ..operators import matchup as u
from ..operators import results as r
from ..sources.tables import SQL_LEDGER as L
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import ledger, matches, sql
from .ledger import MINUTES

c = F.col
#: The day of the board: it shows the week from here.
AS_OF = 10215


def inputs(s, d):
    """Every sixth event is taken as one of a set piece, since the ledger doesn't say."""
    return u.games(r.team_match(matches(s, d)), ledger(s, d).withColumn("set_piece", c("sequence") % 6 == 0))


def fixtures(s, d):
    return matches(s, d).where((c("status") == "scheduled") & c("day").between(AS_OF, AS_OF + 7)).select("match_id", "day", "competition_id", "season", "home_team_id", "away_team_id")


def starters(s, d):
    return g.minutes(ledger(s, d)).where("is_starter").select("match_id", "team_id", "player_id")


def board(s, d):
    played = inputs(s, d)
    return u.board(fixtures(s, d), u.team_profile(played, AS_OF), u.schedule(played, AS_OF), u.continuity(played, starters(s, d), AS_OF))


r2 = lambda x: f"floor(({x}) * 100.0e0 + 0.5) / 100.0e0"
_LOCATED = "event_type = 'shot' and x_m is not null and y_m is not null"
_COUNT = {"shots": "event_type = 'shot'", "on_target": "event_type = 'shot' and outcome = 'success'", "located": _LOCATED, "inside": _LOCATED + " and x_m >= 88.5 and abs(y_m - 34.0) <= 20.16", "left": _LOCATED + " and y_m > 136 / 3", "right": _LOCATED + " and y_m < 68 / 3", "set_pieces": _LOCATED + " and sequence % 6 = 0"}
_of = lambda p, who, name: f"case when any_value(e.match_id) is not null then count(*) filter (where {p} and e.team_id {who} t.team_id) end as \"{name}\""
_goal = lambda mine, half, name: f"case when any_value(e.match_id) is not null then count(*) filter (where (is_goal and e.team_id {'=' if mine else '<>'} t.team_id or is_own_goal and e.team_id {'<>' if mine else '='} t.team_id) and minute {half} 45) end as \"{name}\""
GAMES = f""",
family as (select match_id, min(case source_family when 'wyscout_figshare' then 1 when 'espn' then 2 when 'openligadb' then 3 else 4 end) as r from ledger group by all),
rich as (select l.* from ledger l join family using (match_id) where r = case source_family when 'wyscout_figshare' then 1 when 'espn' then 2 when 'openligadb' then 3 else 4 end),
games as (select t.match_id, t.competition_id, t.season, t.day, t.team_id, t.is_home, t.gf, t.ga, t.points, max(source_family) as family, {", ".join([_of(p, "=", k) for k, p in _COUNT.items()] + [_of(p, "<>", "o_" + k) for k, p in _COUNT.items()])},
  {_goal(True, "<=", "first")}, {_goal(True, ">", "second")}, {_goal(False, "<=", "o_first")}, {_goal(False, ">", "o_second")}
  from team_match t left join rich e on e.match_id = t.match_id group by t.match_id, t.competition_id, t.season, t.day, t.team_id, t.is_home, t.gf, t.ga, t.points),
past as (select *, row_number() over (partition by team_id order by day desc, match_id desc) as k from games where day < {AS_OF})"""
PROFILE = f""",
profile as (select team_id, count(*) as matches, count(shots) as with_stats, count(*) filter (where located > 0) as with_located, {r2("avg(gf)")} as goals_for, {r2("avg(ga)")} as goals_against, {r2("avg(shots)")} as shots_for, {r2("avg(o_shots)")} as shots_against,
  {r2("avg(on_target)")} as on_target_for, {r2("avg(o_on_target)")} as on_target_against, {", ".join(f'{r2(f"""sum("{x}") / nullif(sum(located), 0)::double""")} as {x}_share' for x in ("inside", "left", "right"))},
  {r2('(sum(located) - sum("left") - sum("right")) / nullif(sum(located), 0)::double')} as centre_share, {r2("sum(set_pieces) / nullif(count(*) filter (where located > 0), 0)::double")} as set_pieces_for,
  {", ".join(f'cast(coalesce(sum("{x}"), 0) as bigint) as {n}' for x, n in (("first", "goals_first"), ("second", "goals_second"), ("o_first", "conceded_first"), ("o_second", "conceded_second")))},
  string_agg(case points when 3 then 'W' when 1 then 'D' else 'L' end, '' order by k) filter (where k <= 5) as form, {r2("avg(points) filter (where k <= 5)")} as points_last_five, {r2("avg(points) filter (where is_home)")} as points_home, {r2("avg(points) filter (where not is_home)")} as points_away
  from past where k <= 8 group by all)"""
CALENDAR = f""",
calendar as (select *, {r2("(least(last_14 / 5.0e0, 1.0e0) * 0.5e0 + greatest(0.0e0, 1 - rest / 7.0e0) * 0.3e0) / (0.5e0 + 0.3e0) * 100")} as load from (select team_id, {AS_OF} - max(day) as rest, count(*) filter (where day >= {AS_OF - 7}) as last_7, count(*) filter (where day >= {AS_OF - 14}) as last_14 from past group by all))"""


def elevens_sql(last: int) -> str:
    return f""",
kept as (select team_id, count(*) as elevens, {r2("avg(len(list_intersect(eleven, before)) / len(before)::double)")} as kept from (select team_id, eleven, lag(eleven) over (partition by team_id order by k desc) as before from past
  join (select match_id, team_id, list(distinct player_id) as eleven from minutes where is_starter group by all) using (match_id, team_id) where k <= {last}) group by all)"""


FIXTURES = f""",
fixtures as (select * from matches where status = 'scheduled' and day between {AS_OF} and {AS_OF + 7})"""
_edge = lambda h, a, scale: r2(f"greatest(-1.0e0, least(1.0e0, ({r2(h)} - {r2(a)}) / {scale}))")
_EDGES = {"attack": _edge("(h.shots_for + a.shots_against) / 2", "(a.shots_for + h.shots_against) / 2", "6.0e0"), "defence": _edge("-h.goals_against", "-a.goals_against", "1.2e0"), "shot_profile": _edge("h.inside_share", "a.inside_share", "0.25e0"), "set_piece": _edge("h.set_pieces_for", "a.set_pieces_for", "3.0e0"), "form": _edge("h.points_last_five", "a.points_last_five", "1.5e0"), "rest": _edge("-hc.load", "-ac.load", "40.0e0"), "eleven": _edge("hk.kept", "ak.kept", "0.3e0")}
_WEIGHT = {"attack": "0.2e0", "defence": "0.2e0", "shot_profile": "0.15e0", "set_piece": "0.05e0", "form": "0.15e0", "rest": "0.15e0", "eleven": "0.1e0"}


def mean_sql(weights: dict[str, str]) -> str:
    return f"({' + '.join(f'coalesce({k} * {w}, 0)' for k, w in weights.items())}) / nullif({' + '.join(f'case when {k} is null then 0 else {w} end' for k, w in weights.items())}, 0)"


SIDES = f""",
sides as (select competition_id, season, team_id, {", ".join(f"avg(points) filter (where k <= {n}) as form{n}, count(*) filter (where k <= {n}) as n{n}" for n in (5, 10))}, avg(gf) filter (where k <= 10) as scoring, avg(ga) filter (where k <= 10) as conceding, avg(gf - ga) filter (where k <= 10) as gd, count(*) as played, avg(gf) as season_scoring, avg(ga) as season_conceding,
  avg(points) filter (where is_home) as at_home, count(*) filter (where is_home) as n_home, avg(points) filter (where not is_home) as away, count(*) filter (where not is_home) as n_away from season_past group by all),
style as (select competition_id, season, team_id, family, count(*) as n, avg(shots) as shots, avg(o_shots) as against, avg(shots - o_shots) as diff, avg(on_target - o_on_target) as target_diff from season_past where k <= 10 and shots is not null group by all),
styles as (select match_id, {", ".join(f"{t}.{x} as {t}_{x}" for t in "ha" for x in ("n", "shots", "against", "diff", "target_diff"))} from fixtures f join style h on h.competition_id = f.competition_id and h.season = f.season and h.team_id = f.home_team_id join style a on a.competition_id = f.competition_id and a.season = f.season and a.team_id = f.away_team_id and a.family = h.family
  qualify row_number() over (partition by match_id order by least(h.n, a.n) desc, h.family) = 1)"""
_c = lambda h, a, nh, na, scale, lower=False, least=3: f"case when coalesce({nh}, 0) >= {least} and coalesce({na}, 0) >= {least} then {r2(f'greatest(-1.0e0, least(1.0e0, ({h} - {a}) / {scale}e0)) * {-1 if lower else 1}')} end"
_b = lambda x, n, scale, lower=False: _c(f"h.{x}", f"a.{x}", f"h.{n}", f"a.{n}", scale, lower)
_y = lambda x, scale, lower=False: _c(f"y.h_{x}", f"y.a_{x}", "y.h_n", "y.a_n", scale, lower)
_COMPONENTS = {
    "results": {"form5": _b("form5", "n5", 1.5), "form10": _b("form10", "n10", 1.5), "scoring": _b("scoring", "n10", 1.5), "conceding": _b("conceding", "n10", 1.5, True), "gd": _b("gd", "n10", 2.0), "season_scoring": _b("season_scoring", "played", 1.5), "season_conceding": _b("season_conceding", "played", 1.5, True), "venue": _c("h.at_home", "a.away", "h.n_home", "a.n_away", 1.5)},
    "style": {"shots": _y("shots", 6.0), "suppression": _y("against", 6.0, True), "shot_diff": _y("diff", 6.0), "target_diff": _y("target_diff", 3.0)},
    "schedule": {"rest": _c("hc.rest", "ac.rest", "hc.rest - hc.rest + 1", "ac.rest - ac.rest + 1", 7.0, least=1), "load7": _c("hc.last_7", "ac.last_7", "hc.rest - hc.rest + 1", "ac.rest - ac.rest + 1", 3.0, True, 1), "eleven": _c("hk.kept", "ak.kept", "hk.elevens", "ak.elevens", 0.3, least=2)},
}
_KEYS = [k for of in _COMPONENTS.values() for k in of]
_known = lambda of: "list_filter([" + ", ".join(of) + "], lambda x: x is not null)"
_team = lambda name, tag, side: f"left join {name} {tag} on {tag}.team_id = f.{side}_team_id"
_TEAMS = " ".join(_team(name, tag + x, side) for tag, side in (("h", "home"), ("a", "away")) for name, x in (("calendar", "c"), ("kept", "k")))

QUERIES = {
    "pr12_matchup_inputs": (inputs, "with" + M + "," + TM + "," + L + GAMES + " select * from games"),
    "pr9_team_profile": (lambda s, d: u.team_profile(inputs(s, d), AS_OF), "with" + M + "," + TM + "," + L + GAMES + PROFILE + " select * from profile"),
    "xt4_pr10_board": (
        board,
        "with" + M + "," + TM + "," + L + "," + MINUTES + GAMES + PROFILE + CALENDAR + elevens_sql(8) + FIXTURES + f""",
edges as (select f.match_id, f.day, f.home_team_id, f.away_team_id, hc.load as home_load, ac.load as away_load, {", ".join(f"{e} as {k}" for k, e in _EDGES.items())} from fixtures f {_team("profile", "h", "home")} {_team("profile", "a", "away")} {_TEAMS})
select *, cast(floor(50 + 50 * lean + 0.5) as bigint) as home_rating, cast(floor(50 - 50 * lean + 0.5) as bigint) as away_rating, cast({" + ".join(f"({k} is not null)::int" for k in _EDGES)} as int) as components_used from (select *, {mean_sql(_WEIGHT)} as lean from edges)""".replace("select *, cast(floor(50 +", "select * exclude (lean), cast(floor(50 +"),
    ),
    "pr11_analyzer": (
        lambda s, d: u.analyzer(fixtures(s, d), inputs(s, d), starters(s, d), AS_OF),
        "with" + M + "," + TM + "," + L + "," + MINUTES + GAMES + CALENDAR + elevens_sql(10) + FIXTURES + f""",
season_past as (select * exclude (k), row_number() over (partition by competition_id, season, team_id order by day desc, match_id desc) as k from past)""" + SIDES + f""",
parts as (select f.match_id, h.n10 as hn, a.n10 as an, {", ".join(f"{e} as {k}" for of in _COMPONENTS.values() for k, e in of.items())} from fixtures f left join sides h on h.competition_id = f.competition_id and h.season = f.season and h.team_id = f.home_team_id
  left join sides a on a.competition_id = f.competition_id and a.season = f.season and a.team_id = f.away_team_id left join styles y on y.match_id = f.match_id {_TEAMS}),
means as (select match_id, hn, an, {", ".join(f"list_sum({_known(of)}) / nullif(len({_known(of)}), 0) as {name}" for name, of in _COMPONENTS.items())}, cast({" + ".join(f"({k} is not null)::int" for k in _KEYS)} as int) as components_used, concat_ws(',', {", ".join(f"case when {k} is null then '{k}' end" for k in _KEYS)}) as omitted from parts)
select match_id, cast(floor(50 + 50 * lean + 0.5) as bigint) as home_rating, cast(floor(50 - 50 * lean + 0.5) as bigint) as away_rating, components_used, omitted, case when lean is null then 'withheld' when style is not null then 'results and shots' else 'results and schedule' end as label
  from (select *, case when coalesce(hn, 0) >= 3 and coalesce(an, 0) >= 3 and components_used >= 3 then {mean_sql({"results": "0.5e0", "style": "0.3e0", "schedule": "0.2e0"})} end as lean from means)""",
    ),
    "pr11_season_context": (
        lambda s, d: u.season_context(r.team_match(matches(s, d))),
        sql("""select competition_id, team_id, season, "window", seasons, matches, played, sb as scored_before, cb as conceded_before, sc as scored, co as conceded, floor((sc - sb) * 100 + 0.5) / 100 as scored_change, floor((co - cb) * 100 + 0.5) / 100 as conceded_change from (
  select competition_id, team_id, season, "window", played, count(k) as seasons, cast(sum(p) as bigint) as matches, floor(sum(f) * 1.0e0 / sum(p) * 100 + 0.5) / 100 as sb, floor(sum(g) * 1.0e0 / sum(p) * 100 + 0.5) / 100 as cb, floor(gf * 1.0e0 / played * 100 + 0.5) / 100 as sc, floor(ga * 1.0e0 / played * 100 + 0.5) / 100 as co from (
    select a.*, "window", b.season as k, b.played as p, b.gf as f, b.ga as g, row_number() over (partition by a.competition_id, a.team_id, a.season, "window" order by b.season desc) as back from seasons a join seasons b on a.competition_id = b.competition_id and a.team_id = b.team_id and b.season < a.season, (select cast(unnest([3, 5]) as int) as "window"))
  where back <= "window" group by competition_id, team_id, season, "window", played, gf, ga)""", M, TM, """
seasons as (select competition_id, team_id, season, count(*) as played, sum(gf) as gf, sum(ga) as ga from team_match group by all)"""),
    ),
    "pr11_meetings": (
        lambda s, d: u.meetings_before(matches(s, d).where("status = 'scheduled'"), matches(s, d), AS_OF),
        sql(f"""select f.match_id, count(m.match_id) as meetings, count(*) filter (where won) as home_won, count(*) filter (where drawn) as drawn, count(*) filter (where not won and not drawn) as away_won, cast(coalesce(sum(gf), 0) as bigint) as home_goals, cast(coalesce(sum(ga), 0) as bigint) as away_goals, max(m.day) as last_day
  from (select match_id, home_team_id as h, away_team_id as a from matches where status = 'scheduled') f left join (select match_id, day, team_id, opponent_id, points = 3 as won, points = 1 as drawn, gf, ga from team_match where day < {AS_OF}) m on m.team_id = f.h and m.opponent_id = f.a group by f.match_id""", M, TM),
    ),
}

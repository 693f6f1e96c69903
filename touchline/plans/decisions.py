"""Queries of decisions with reasons, pick policies and guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..operators import decisions as k
from ..operators import models as m
from ..operators import results as r
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import matches, sql, table
from .models import STRENGTH, expected, judged, r6, rounded

c = F.col
S = lambda body: sql(body, M, TM)
J = lambda body, *more: sql(body, M, TM, STRENGTH, *more)
NOW = 10227
CUT_DAY = 10200
#: The strengths once more, from rows that end with a day.
CUT = f"""
team_match_cut as (select * from team_match where day <= {CUT_DAY})""" + "," + STRENGTH[: STRENGTH.index("expected as")].rstrip().rstrip(",").replace("from team_match", "from team_match_cut").replace("scaled", "scaled_cut").replace("league", "league_cut").replace("from team join", "from team_cut join").replace("team as (", "team_cut as (").replace("strengths as (", "strengths_cut as (")
_pair = lambda t: f"case when {t}.attack is not null then (floor({t}.attack * 1e9 + 0.5), floor({t}.defence * 1e9 + 0.5)) end"
_ahead = lambda rows: f"select match_id, team_id, day, avg(gf) over (partition by competition_id order by day range between 30 preceding and 30 following) as attack from {rows}"


def looks_ahead(rows):
    """A mean that sees the days to come: what the check has to find."""
    w = Window.partitionBy("competition_id").orderBy("day").rangeBetween(-30, 30)
    return rows.select("match_id", "team_id", "day", F.avg("gf").over(w).alias("attack"), F.lit(0.0).alias("defence"))


def truncation(s, d):
    """Changed values of an operator that looks back only, and of one that doesn't."""
    rows = r.team_match(matches(s, d))
    builds = {"strengths": lambda x: m.decayed_strengths(x).withColumns({k: half_up(c(k), 9) for k in ("attack", "defence")}), "looks ahead": looks_ahead}
    checks = [m.truncation_differences(b, rows, ["match_id", "team_id"], ["attack", "defence"], CUT_DAY).withColumn("build", F.lit(name)) for name, b in builds.items()]
    return checks[0].unionByName(checks[1])


def athletes(s, d):
    t = table(s, d, "customer").withColumn("k", c("c_custkey"))
    person = lambda id_, country, *more: t.select(id_, F.concat(F.lit("Náme "), (c("k") % 900).cast("string")).alias("name"), (c("k") % 50).alias("born"), country.alias("country"), *more)
    ours = person(c("k").alias("player_id"), F.when(c("k") % 7 != 0, (c("c_nationkey") + (c("k") % 19 == 0).cast("int")) % 3), F.when(c("k") % 17 == 0, c("k") + 20000).when(c("k") % 16 == 0, c("k") + 10000).alias("other_id"))
    theirs = person((c("k") + 10000).alias("athlete_id"), c("c_nationkey") % 3)
    windows = t.select(c("k").alias("player_id"), F.explode(F.array(F.struct(F.lit(1995).alias("season"), c("c_nationkey").alias("team_id")), F.struct(F.lit(1996).alias("season"), ((c("c_nationkey") + 1) % 25).alias("team_id")))).alias("w")).select("player_id", "w.*")
    clubs = t.where("k % 4 <> 0").select((c("k") + 10000).alias("athlete_id"), F.lit(1995).alias("season"), F.when(c("k") % 5 == 0, c("c_nationkey") + 3).otherwise(c("c_nationkey")).alias("team_id"))
    return k.corroborated(theirs, ours, windows, clubs)


def guarded(s, d):
    n, g = table(s, d, "nation"), table(s, d, "region")
    teams = n.select(c("n_nationkey").alias("team_id"), F.when(c("n_nationkey") % 4 == 0, "national").otherwise("club").alias("team_type"), F.when(c("n_nationkey") % 6 == 0, "women").otherwise("men").alias("gender"))
    competitions = g.select(c("r_regionkey").alias("competition_id"), (c("r_regionkey") == 1).alias("national"), F.when(c("r_regionkey") == 2, "women").otherwise("men").alias("gender"))
    return k.guarded(table(s, d, "customer").select(c("c_name").alias("external_id"), (c("c_custkey") % 5).cast("int").alias("competition_id"), c("c_nationkey").alias("team_id")), teams, competitions)


def listings(s, d):
    return k.listings(matches(s, d).select(c("match_id").alias("listing_id"), "season", c("home_team_id").alias("home"), c("away_team_id").alias("away"), "day", "status", "home_score", "away_score"), 30)


def formats(s, d):
    x = matches(s, d)
    reviewed = x.where("status = 'finished' and match_id % 40 = 0").select(c("match_id").alias("fixture_id"), (c("day") - c("match_id") % 2).alias("day"), c("away_team_id").alias("team_a"), c("home_team_id").alias("team_b"), (c("away_score") + F.when(c("match_id") % 120 == 0, 7).otherwise(0)).alias("goals_a"), c("home_score").alias("goals_b"))
    return k.reviewed_format(x, reviewed)


STAGED = """,
reviewed as (select match_id as fixture_id, day - match_id % 2 as day, away_team_id as a, home_team_id as b, away_score + case when match_id % 120 = 0 then 7 else 0 end as ga, home_score as gb from matches where status = 'finished' and match_id % 40 = 0),
met as (select distinct fixture_id, m.match_id from reviewed f join matches m on m.status = 'finished' and m.day in (f.day, f.day + 1) and ((m.home_team_id = a and m.away_team_id = b and m.home_score = ga and m.away_score = gb) or (m.home_team_id = b and m.away_team_id = a and m.home_score = gb and m.away_score = ga))),
one as (select match_id, min(fixture_id) as fixture_id from (select fixture_id, min(match_id) as match_id from met group by fixture_id having count(*) = 1) group by all),
staged as (select match_id, competition_id, season, home_team_id, away_team_id, fixture_id, case when fixture_id is not null then 'playoff' when status = 'finished' then 'league' end as stage from matches left join one using (match_id))"""


def videos(s, d):
    x = matches(s, d)
    q = c("match_id")
    score = F.concat_ws("-", c("home_score").cast("string"), c("away_score").cast("string"))
    teams = F.when(q % 9 == 0, F.array("home_team_id", "away_team_id", ((c("away_team_id") + 1) % 25).cast("int"))).when(q % 4 == 0, F.array("home_team_id")).otherwise(F.array("home_team_id", "away_team_id"))
    shown = x.where("status = 'finished' and match_id % 3 = 0").select(q.alias("video_id"), (c("day") + q % 2).alias("day"), F.when(q % 2 == 0, "highlights").otherwise("recap").alias("kind"), teams.alias("teams"), F.when(q % 5 != 0, score).alias("score"))
    return k.video_links(shown, x.where("status = 'finished'").select(q.alias("article_id"), "day", c("home_team_id").alias("home"), c("away_team_id").alias("away"), score.alias("score")))


def headline_entities(s, d):
    kind = F.when(c("l_returnflag") == "A", "Person").when(c("l_returnflag") == "N", "SportsTeam").otherwise("SportsEvent")
    return k.subjects(table(s, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("place"), kind.alias("type"), c("l_partkey").alias("entity"), (c("l_partkey") % 50 == 0).alias("marked"), (c("l_suppkey") % 2 == 0).alias("in_headline")))


def outside_records(s, d):
    q = c("p_partkey")
    return k.agreed_media(table(s, d, "part").select(q.alias("player_id"), c("p_size").alias("born"), F.when(q % 11 != 0, c("p_size") + F.when(q % 5 == 0, 1).otherwise(0)).alias("item_born"), (q % 13 != 0).alias("is_human"), F.when(q % 3 == 0, F.array(q, q + 1)).otherwise(F.array(q)).alias("ids"), q.alias("own_id"), F.array_repeat(F.lit("i"), (q % 4).cast("int")).alias("images")))


def observed(s, d):
    x = matches(s, d).where("status = 'finished'").select("match_id", "home_score", "away_score", F.concat(F.lit("s"), (c("competition_id") % 3).cast("string")).alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).where("match_id % 10 <> n")
    rows = x.select("match_id", "owner", F.concat(F.lit("s"), c("n").cast("string")).alias("source"), (c("home_score") + ((c("match_id") % 97 == 0) & (c("n") == 1)).cast("int")).alias("home_score"), "away_score", (c("match_id") % 5 + c("n")).alias("at"))
    earlier = rows.withColumn("at", c("at") - 10).withColumn("away_score", c("away_score") + 1)
    return k.by_precedence(rows.unionByName(earlier))


def names(s, d):
    q = c("c_custkey")
    first, last = F.when(q % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("First"), q.cast("string"))), F.when(q % 25 != 0, F.concat(F.lit("Last"), q.cast("string")))
    short = F.when(q % 3 == 0, F.concat(F.lit("F. Last"), q.cast("string"))).when(q % 3 == 1, F.concat(F.lit("Shorty"), q.cast("string")))
    return table(s, d, "customer").select("c_custkey", k.display_name(first, last, short).alias("name"))


def issues(s, d):
    x = matches(s, d)
    past = x.withColumn("home_score", F.when(c("competition_id") < 2, F.coalesce("home_score", F.lit(0))).otherwise(c("home_score"))).withColumn("status", F.when(c("competition_id") < 2, "finished").otherwise(c("status")))
    return k.issue(x, x.where("match_id % 3 = 0").select("match_id"), past, NOW, window=14)


GRID = [(a, b, g) for a in (0.2, 0.4, 0.8) for b in (-1.5, -1.0, -0.5) for g in (0.8, 1.2)]


def offers(s, d):
    j = judged(s, d)
    goals = c("home_score") + c("away_score")
    each = F.array(F.struct(F.lit("home").alias("market"), half_up(c("home"), 6).alias("probability"), (c("y") == 0).alias("hit")), F.struct(F.lit("over25").alias("market"), half_up(c("over25"), 6).alias("probability"), (goals > 2).alias("hit")))
    return k.policy_statistics(j.select("season", F.explode(each).alias("o")).select("season", "o.*"), [0.3, 0.4, 0.5, 0.6])


HELD_FROM = 1996
r4 = lambda x: f"floor(({x}) * 1e4 + 0.5) / 1e4"


def held_out(s, d):
    """Three markets over the later seasons, against fixed base rates."""
    j = judged(s, d).where(c("season") >= HELD_FROM)
    goals = c("home_score") + c("away_score")
    offer = lambda market, p, hit, base: F.struct(F.lit(market).alias("market"), half_up(c(p), 6).alias("probability"), hit.alias("hit"), F.lit(base).alias("base"))
    each = F.array(offer("home", "home", c("y") == 0, 0.45), offer("over25", "over25", goals > 2, 0.5), offer("both", "both", (c("home_score") > 0) & (c("away_score") > 0), 0.5))
    return k.holdout_rules(j.select("season", F.explode(each).alias("o")).select("season", "o.*"), {"home": 0.3, "over25": 0.4, "both": 0.99})


HOLDOUT_SQL = J("select *, failed = '' as active from f", f"""
o as (select season, unnest(['home', 'over25', 'both']) as market, unnest([{r6('home')}, {r6('over25')}, {r6('"both"')}]) as p, unnest([y = 0, home_score + away_score > 2, home_score > 0 and away_score > 0]) as hit, unnest([0.45e0, 0.5e0, 0.5e0]) as base, unnest([0.3e0, 0.4e0, 0.99e0]) as threshold from judged where season >= {HELD_FROM}),
s as (select market, threshold, season, count(*) as r, count(*) filter (where p >= threshold) as n, coalesce(sum(hit::int) filter (where p >= threshold), 0) as hits, coalesce(sum(p) filter (where p >= threshold), 0) as sp, coalesce(sum(base) filter (where p >= threshold), 0) as sb,
  sum(-ln(case when hit then p else 1 - p end)) as l, sum(pow(p - hit::int, 2)) as q, sum(-ln(case when hit then base else 1 - base end)) as bl, sum(pow(base - hit::int, 2)) as bq from o group by all),
m as (select market, threshold, cast(sum(n) as bigint) as n, cast(sum(hits) as bigint) as hits, {r4('sum(hits) * 1.0e0 / nullif(sum(n), 0)')} as hit_rate, {r4('sum(sp) / nullif(sum(n), 0)')} as mean_probability, {r4('sum(sb) / nullif(sum(n), 0)')} as base_rate, sum(hits) * 1.0e0 / nullif(sum(n), 0) as h, nullif(sum(n), 0) as k,
  count(*) filter (where n >= 10 and {r4('hits * 1.0e0 / n')} < {r4('sp / n')} - 0.10) as weak_seasons, {r4('sum(l) / sum(r)')} as log_loss, {r4('sum(q) / sum(r)')} as brier, {r4('sum(bl) / sum(r)')} as base_log_loss, {r4('sum(bq) / sum(r)')} as base_brier from s group by all),
w as (select * exclude (h, k), {r4('(h + 3.8416 / (2 * k) - 1.96 * sqrt((h * (1 - h) + 3.8416 / (4 * k)) / k)) / (1 + 3.8416 / k)')} as wilson_low from m),
f as (select *, array_to_string(list_filter([case when not (log_loss < base_log_loss and brier < base_brier) then 'H0' end, case when coalesce(hit_rate < mean_probability - 0.04, true) then 'H1' end, case when coalesce(wilson_low < 0.5, true) then 'H2' end, case when coalesce(hit_rate - base_rate < 0.08, true) then 'H3' end, case when n < 20 then 'H4' end, case when weak_seasons > 0 then 'H5' end], lambda x: x is not null), ',') as failed from w)""")


def monthly(s, d):
    j = judged(s, d).join(matches(s, d).select("match_id", F.date_format("kickoff_at", "yyyy-MM").alias("month")), "match_id")
    return k.shadow_metrics(j, [0.45, 0.25, 0.3])


def states(s, d):
    q = c("s_suppkey")
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("results", "match", "lineup", "events")]), (q % n + 1).cast("int"))
    t = table(s, d, "supplier")
    return k.never_lower(t.select(q.alias("id"), pick(3).alias("state")), t.select(q.alias("id"), F.when(q % 7 != 0, pick(4)).alias("state")), "id", "state", ["results", "match", "lineup", "events"])


def refused(s, d):
    q = c("match_id")
    x = matches(s, d)
    made = x.select((q + 1_000_000).alias("forecast_id"), F.when(q % 41 == 0, -q).otherwise(q).alias("match_id"), (c("day") + (q % 11 == 0).cast("int")).alias("kickoff"), (F.lit(NOW - 30) + q % 37).alias("issued"), (F.lit(NOW - 31) + q % 38).alias("input_as_of"))
    return k.refused_issues(made, x, NOW)


def rights(s, d):
    q = c("p_partkey")
    text = lambda n, v: F.when(q % n != 0, v).otherwise(F.lit(" "))
    return k.incomplete_rights(table(s, d, "part").select(q.alias("media_id"), F.when(c("p_size") > 10, "approved").otherwise("open").alias("status"), text(5, c("p_brand")).alias("licence"), F.when(q % 7 != 0, c("p_name")).alias("attribution"), text(11, c("p_type")).alias("source"), text(13, F.lit("desk")).alias("reviewed_by")))


STATE = "list_extract(['results', 'match', 'lineup', 'events'], cast(s_suppkey % {} + 1 as int))"
QUERIES = {
    "id4_corroborated": (
        athletes,
        """with t as (select *, c_custkey as k from customer), ours as (select k as player_id, k % 900 as name, k % 50 as born, case when k % 7 <> 0 then (c_nationkey + (k % 19 = 0)::int) % 3 end as country, case when k % 17 = 0 then k + 20000 when k % 16 = 0 then k + 10000 end as other_id, c_nationkey as nk from t),
met as (select t.k, count(*) as n, min(player_id) as player_id from t join ours o on t.k % 900 = o.name and t.k % 50 = o.born group by all),
one as (select t.k, t.c_nationkey, n, o.* from t left join met using (k) left join ours o using (player_id)),
told as (select *, k % 4 <> 0 as has, case when k % 5 = 0 then c_nationkey + 3 else c_nationkey end as club from one),
why as (select *, case when n is null then 'no_candidate' when n > 1 then 'multiple_candidates' when other_id is not null and other_id <> k + 10000 then 'contradiction_provider_id' when country <> c_nationkey % 3 then 'contradiction_nationality' when has and club <> nk then 'contradiction_club' when not has then 'no_club_in_common' end as reason from told)
select k + 10000 as athlete_id, case when reason is null then player_id end as player_id, case when reason is null then 'merge' else 'queue' end as decision, reason from why""",
    ),
    "id8_guarded": (
        guarded,
        """select c_name as external_id, cast(c_custkey % 5 as int) as competition_id, c_nationkey as team_id, reason from (select *, case when c_custkey % 5 = 1 and c_nationkey % 4 <> 0 then 'club_in_national_competition' when (c_nationkey % 6 = 0) <> (c_custkey % 5 = 2) then 'gender_differs' end as reason from customer) where reason is not null""",
    ),
    "id9_listings": (
        listings,
        S("""select match_id as listing_id, case when others > 0 and not done then 'replaced' when same > 0 then 'unclear' when not done and finished > 0 then 'replaced' else 'match' end as verdict from (
  select a.match_id, a.done, a.finished, count(b.match_id) as others, count(*) filter (where b.match_id is not null and not coalesce(b.done and b.day <> a.day and (b.home_score <> a.home_score or b.away_score <> a.away_score), false)) as same from numbered a
  left join numbered b on a.season = b.season and a.home_team_id = b.home_team_id and a.away_team_id = b.away_team_id and b.k < a.k and abs(a.day - b.day) <= 30 group by all)""".replace("numbered", "(select *, status = 'finished' as done, row_number() over (partition by season, home_team_id, away_team_id order by status = 'finished' desc, day, match_id) as k, count(*) filter (where status = 'finished') over (partition by season, home_team_id, away_team_id) as finished from matches)")),
    ),
    "id13_reviewed_format": (formats, "with" + M + STAGED + " select * from staged"),
    "id14_league_games": (lambda s, d: k.league_games(formats(s, d)), "with" + M + STAGED + " select competition_id, season, team_id, count(*) as games from (select competition_id, season, unnest([home_team_id, away_team_id]) as team_id from staged where stage = 'league') group by all"),
    "id15_video_links": (
        videos,
        S("""select video_id, case when points >= 75 then article_id end as article_id, points, candidates from (select video_id, cast(max(points) as bigint) as points, arg_max(article_id, points * 100000000 - article_id) as article_id, count(*) as candidates from (
  select v.match_id as video_id, a.match_id as article_id, case when v.match_id % 4 = 0 and v.match_id % 9 <> 0 then case when list_contains([v.home_team_id], a.home_team_id) and list_contains([v.home_team_id], a.away_team_id) then 40 else 15 end when list_contains(v.teams, a.home_team_id) and list_contains(v.teams, a.away_team_id) then 40 else 15 end
    + case when v.vday = a.day then 20 when abs(v.vday - a.day) = 1 then 10 else 0 end + case when v.score = a.score then 25 else 0 end + case when v.match_id % 2 = 0 then 10 else 0 end + cast(0 as bigint) as points, list_contains(v.teams, a.home_team_id) and list_contains(v.teams, a.away_team_id) as is_both, v.score as vs, a.score as sc, len(list_filter(v.teams, lambda t: t <> a.home_team_id and t <> a.away_team_id)) > 0 as others
  from (select *, day + match_id % 2 as vday, case when match_id % 9 = 0 then [home_team_id, away_team_id, cast((away_team_id + 1) % 25 as int)] when match_id % 4 = 0 then [home_team_id] else [home_team_id, away_team_id] end as teams, case when match_id % 5 <> 0 then home_score || '-' || away_score end as score from matches where status = 'finished' and match_id % 3 = 0) v
  join (select *, home_score || '-' || away_score as score from matches where status = 'finished') a on abs(v.vday - a.day) <= 3 and (list_contains(v.teams, a.home_team_id) or list_contains(v.teams, a.away_team_id)))
  where not others and not (not is_both and vs is null) and not coalesce(vs <> sc, false) group by all)"""),
    ),
    "id18_subjects": (
        headline_entities,
        """select id, type, entity, list_extract(['marked', 'person in headline', 'team in headline', 'class default'], rank + 1) as reason from (select *, row_number() over (partition by id order by rank, l_linenumber, entity, type) as k from (select *, case when l_partkey % 50 = 0 then 0 when type = 'Person' and l_suppkey % 2 = 0 then 1 when type = 'SportsTeam' and l_suppkey % 2 = 0 then 2 else 3 end as rank
  from (select *, l_orderkey as id, l_partkey as entity, case l_returnflag when 'A' then 'Person' when 'N' then 'SportsTeam' else 'SportsEvent' end as type from lineitem))) where k = 1""",
    ),
    "id20_agreed_media": (
        outside_records,
        "select p_partkey as player_id, reason is null as agrees, reason from (select p_partkey, case when p_partkey % 13 = 0 then 'not_human' when p_partkey % 11 = 0 or p_partkey % 5 = 0 then 'birth_date' when p_partkey % 3 = 0 then 'other_provider_id' when p_partkey % 4 <> 1 then 'images' end as reason from part)",
    ),
    "ing10_slugs": (
        lambda s, d: k.slugs(table(s, d, "part").select(c("p_partkey").alias("entity"), c("p_name").alias("name"), c("p_size").alias("year")), table(s, d, "part").where("p_size = 1").select(F.regexp_replace("p_name", " ", "-").alias("slug"))),
        """with b as (select p_partkey as entity, regexp_replace(p_name, '[^a-z0-9]+', '-', 'g') as base, p_size as year, md5(cast(p_partkey as varchar)) as h from part), taken as (select distinct regexp_replace(p_name, ' ', '-', 'g') as slug from part where p_size = 1),
r0 as (select base as slug, min(entity) as entity from b where base not in (from taken) group by base), l1 as (select * from b where entity not in (select entity from r0)),
r1 as (select base || '-' || year as slug, min(entity) as entity from l1 where base || '-' || year not in (from taken) and base || '-' || year not in (select slug from r0) group by 1), l2 as (select * from l1 where entity not in (select entity from r1)),
r2 as (select base || '-' || h[1:6] as slug, min(entity) as entity from l2 group by 1)
from r0 union all from r1 union all from r2""",
    ),
    "ing7_conditional_update": (
        lambda s, d: k.conditional_update(matches(s, d).select("match_id", "status", "day"), (c("status") == "scheduled") & (c("day") < NOW), {"status": F.lit("unknown")}).select("match_id", "status", "updated"),
        S(f"select match_id, case when status = 'scheduled' and day < {NOW} then 'unknown' else status end as status, status = 'scheduled' and day < {NOW} as updated from matches"),
    ),
    "ing16_by_precedence": (
        observed,
        S("""select match_id, case when own then home_score + (match_id % 97 = 0 and competition_id % 3 = 1)::int end as home_score, case when own then away_score end as away_score, observers, case when own and match_id % 97 = 0 then case when competition_id % 3 = 1 then (observers > 0)::bigint else (match_id % 10 <> 1)::bigint end else 0 end as disagreements from (
  select *, match_id % 10 <> competition_id % 3 as own, cast(3 - (match_id % 10 in (0, 1, 2))::int - (match_id % 10 <> competition_id % 3)::int as bigint) as observers from matches where status = 'finished')"""),
    ),
    "fn14_display_names": (
        names,
        """select c_custkey, case when c_custkey % 3 = 1 then 'Shorty' || c_custkey when c_custkey % 25 = 0 then case when c_custkey % 3 = 0 then 'F. Last' || c_custkey else 'unknown' end when c_custkey % 5 = 0 then 'Last' || c_custkey else 'First' || c_custkey || ' Last' || c_custkey end as name from customer""",
    ),
    "ml2_leaks": (
        lambda s, d: m.leaks(r.team_match(matches(s, d))),
        S("""select competition_id, count(*) as n, count(*) filter (where a is distinct from b) as changed from (select competition_id, avg(gf) over (partition by competition_id order by day, match_id, team_id rows between unbounded preceding and 1 preceding) as a,
  avg(gf) over (partition by competition_id order by day range between unbounded preceding and 1 preceding) as b from team_match) group by all"""),
    ),
    "ml9_ordered_logit": (
        lambda s, d: k.ordered_logit(judged(s, d), half_up(c("home_rate") - c("away_rate"), 2), GRID),
        J(f"""select a, {r6('c1')} as c1, {r6('c2')} as c2, {r6('avg(-ln(greatest(1e-12, p)))')} as log_loss from (select a, c1, c2, case y when 0 then 1 - 1 / (1 + exp(-(c2 - a * x))) when 1 then greatest(1e-12, 1 / (1 + exp(-(c2 - a * x))) - 1 / (1 + exp(-(c1 - a * x)))) else 1 / (1 + exp(-(c1 - a * x))) end as p from
  (select floor((home_rate - away_rate) * 100 + 0.5) / 100 as x, y from judged), (select cast(a as double) as a, cast(b as double) as c1, cast(b + g as double) as c2 from (select unnest([0.2, 0.4, 0.8]) as a), (select unnest([-1.5, -1.0, -0.5]) as b), (select unnest([0.8, 1.2]) as g))) group by a, c1, c2"""),
    ),
    "ml19_policy_statistics": (
        offers,
        J(f"""select market, threshold, n, hits, hit_rate, mean_probability, wilson_low, seasons, worst, failed, failed = '' as eligible from (select *, array_to_string(list_filter([case when n < 30 then 'E0' end, case when hit_rate < 0.5 then 'E1' end, case when wilson_low < 0.45 then 'E2' end, case when hit_rate < mean_probability - 0.05 then 'E3' end, case when seasons < 2 then 'E4' end, case when worst < 0.4 then 'E5' end], lambda x: x is not null), ',') as failed from (
  select market, threshold, n, hits, {r6('h')} as hit_rate, {r6('p / n')} as mean_probability, {r6('((h + 3.8416 / (2 * n) - 1.96 * sqrt((h * (1 - h) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))')} as wilson_low, seasons, {r6('worst')} as worst from (select market, threshold, cast(sum(n) as bigint) as n, cast(sum(hits) as bigint) as hits, sum(hits) * 1.0e0 / sum(n) as h, sum(p) as p, count(*) as seasons, min(hits * 1.0e0 / n) as worst from (
  select market, threshold, season, count(*) as n, sum(hit::int) as hits, sum(probability) as p from (select season, unnest(['home', 'over25']) as market, unnest([{r6('home')}, {r6('over25')}]) as probability, unnest([y = 0, home_score + away_score > 2]) as hit from judged), (select cast(unnest([0.3, 0.4, 0.5, 0.6]) as double) as threshold) where probability >= threshold group by all) group by all)))"""),
    ),
    "ml19_holdout_rules": (
        held_out,
        HOLDOUT_SQL,
    ),
    "ml22_issue": (
        issues,
        sql(f"""select match_id, competition_id, case when reason is null then 'issue' else 'hold' end as decision, reason, input_as_of from (select m.*, input_as_of, case when missing > 0 then 'prior_result_unavailable' when input_as_of is null then 'no_time_safe_inputs' end as reason from matches m join p using (competition_id) where status = 'scheduled' and day - 1 >= {NOW} and day <= {NOW + 14} and match_id % 3 <> 0)""", M, f"\np as (select competition_id, count(*) filter (where day < {NOW} and competition_id >= 2 and status <> 'postponed' and (status <> 'finished' or home_score is null)) as missing, max(day) filter (where day < {NOW} and (competition_id < 2 or status = 'finished')) as input_as_of from matches group by all)"),
    ),
    "ml26_frozen_members": (
        lambda s, d: k.frozen_members(matches(s, d).select("match_id", "day"), matches(s, d).where("match_id % 2 = 0 and day <= 10000").select("match_id"), 10300),
        S("select match_id, match_id % 2 = 0 and day <= 10000 as listed from matches where (match_id % 2 = 0 and day <= 10000) or day > 10300"),
    ),
    "ml27_shadow_metrics": (
        monthly,
        J("select season, month, count(*) as n, " + ", ".join(f"floor(({e}) * 1e4 + 0.5) / 1e4 as {n}" for n, e in {
            "log_loss": "avg(-ln(greatest(hit, 1e-12)))", "brier": "avg(pow(home - (y = 0)::int, 2) + pow(draw - (y = 1)::int, 2) + pow(away - (y = 2)::int, 2))", "base_log_loss": "avg(-ln(case y when 0 then 0.45e0 when 1 then 0.25e0 else 0.3e0 end))",
            "home_predicted": "avg(home)", "draw_predicted": "avg(draw)", "away_predicted": "avg(away)", "home_observed": "avg((y = 0)::int)", "draw_observed": "avg((y = 1)::int)", "away_observed": "avg((y = 2)::int)"}.items())
          + " from (select j.*, strftime(kickoff_at, '%Y-%m') as month from judged j join matches using (match_id)) group by grouping sets ((), (season), (month))"),
    ),
    "ml28_truncation": (
        truncation,
        J(f"""select build, count(*) as compared, count(*) filter (where a is distinct from b) as different from (
  select 'strengths' as build, {_pair("x")} as a, {_pair("y")} as b from (select * from strengths where day <= {CUT_DAY}) x full join strengths_cut y using (match_id, team_id)
  union all select 'looks ahead', case when x.attack is not null then (x.attack, 0e0) end, case when y.attack is not null then (y.attack, 0e0) end from (select * from ({_ahead("team_match")}) where day <= {CUT_DAY}) x full join ({_ahead("team_match_cut")}) y using (match_id, team_id)) group by all""", CUT),
    ),
    "xt19_scoreline_loss": (
        lambda s, d: rounded(m.scoreline_loss(expected(s, d), matches(s, d)), "log_likelihood", "log_loss"),
        J(f"select count(*) as n, {r6('sum(ln(greatest(p, 1e-12)))')} as log_likelihood, {r6('-avg(ln(greatest(p, 1e-12)))')} as log_loss from (select g.p / w as p from grid g join (select match_id, sum(p) as w from grid group by all) using (match_id) join matches m on m.match_id = g.match_id and status = 'finished' and i = home_score and j = away_score)"),
    ),
    "dq5_incomplete_rights": (
        rights,
        "select media_id, missing from (select p_partkey as media_id, array_to_string(list_filter([case when p_partkey % 5 = 0 then 'licence' end, case when p_partkey % 7 = 0 then 'attribution' end, case when p_partkey % 11 = 0 then 'source' end, case when p_partkey % 13 = 0 then 'reviewed_by' end], lambda x: x is not null), ',') as missing from part where p_size > 10) where missing <> ''",
    ),
    "dq8_refused_issues": (
        refused,
        S(f"""select match_id_ + 1000000 as forecast_id, case when match_id_ % 41 = 0 then -match_id_ else match_id_ end as match_id, reason from (select match_id as match_id_, case when match_id % 41 = 0 and match_id <> 0 then 'unknown match' when status <> 'scheduled' then 'not scheduled' when match_id % 11 = 0 then 'other kickoff' when {NOW - 30} + match_id % 37 > {NOW} then 'future dated'
  when {NOW - 30} + match_id % 37 >= day then 'after kickoff' when {NOW - 31} + match_id % 38 >= {NOW - 30} + match_id % 37 then 'inputs not before issue' end as reason from matches) where reason is not null"""),
    ),
    "dq11_never_lower": (
        states,
        f"select s_suppkey as id, case when n is null or n < o then {STATE.format(3)} else {STATE.format(4)} end as state, coalesce(n < o, false) as refused from (select *, s_suppkey % 3 as o, case when s_suppkey % 7 <> 0 then s_suppkey % 4 end as n from supplier)",
    ),
}

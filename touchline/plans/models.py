"""Queries of forecasts, evaluation and picks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..operators import models as m
from ..operators import ratings
from ..operators import results as r
from ..sources.tables import SQL_MATCHES as M
from ..sources.tables import SQL_TEAM_MATCH as TM
from ..sources.tables import matches, sql

H, RHO = m.HALF_LIFE, -0.1099
c = F.col
rounded = lambda df, *names: df.select(*[half_up(c(n), 6).alias(n) if n in names else c(n) for n in df.columns])


def expected(s, d):
    return m.rates(m.decayed_strengths(r.team_match(matches(s, d))))


def forecasts(s, d):
    return m.markets(expected(s, d))


def judged(s, d):
    return m.outcomes(forecasts(s, d), matches(s, d))


def r6(x):
    return f"floor({x} * 1e6 + 0.5) / 1e6"


STRENGTH = f"""
scaled as (select *, pow(2.0, (day - 9000) / {H}) as w from team_match),
league as (select competition_id, day, sum(dw) over v as lw, sum(dg) over v as lg from (select competition_id, day, sum(w) as dw, sum(w * gf) as dg from scaled group by all) window v as (partition by competition_id order by day range between 2700 preceding and 1 preceding)),
team as (select *, sum(w) over v as tw, sum(w * gf) over v as tf, sum(w * ga) over v as ta, pow(2.0, -(day - 9000) / {H}) as decay from scaled window v as (partition by competition_id, team_id order by day range between 2700 preceding and 1 preceding)),
strengths as (select match_id, competition_id, team_id, day, is_home, lg / lw as mean_goals, (coalesce(tf, 0) * decay + 10 * lg / lw) / (coalesce(tw, 0) * decay + 10) / (lg / lw) as attack,
  (coalesce(ta, 0) * decay + 10 * lg / lw) / (coalesce(tw, 0) * decay + 10) / (lg / lw) as defence, coalesce(tw, 0) * decay as weight from team join league using (competition_id, day) where lw > 0 and lg > 0),
expected as (select h.match_id, h.mean_goals * h.attack * a.defence as home_rate, h.mean_goals * a.attack * h.defence as away_rate from strengths h join strengths a on h.match_id = a.match_id and h.is_home and not a.is_home),
grid as (select match_id, home_rate, away_rate, i, j, exp(-home_rate) * pow(home_rate, i) / factorial(i) * exp(-away_rate) * pow(away_rate, j) / factorial(j) *
  case when i = 0 and j = 0 then greatest(0, 1 - home_rate * away_rate * {RHO}) when i = 0 and j = 1 then greatest(0, 1 + home_rate * {RHO}) when i = 1 and j = 0 then greatest(0, 1 + away_rate * {RHO}) when i = 1 and j = 1 then 1 - {RHO} else 1 end as p
  from expected, (select cast(unnest(range(11)) as int) as i), (select cast(unnest(range(11)) as int) as j)),
forecast as (select match_id, home_rate, away_rate, sum(p) filter (where i > j) / sum(p) as home, sum(p) filter (where i = j) / sum(p) as draw, sum(p) filter (where i < j) / sum(p) as away, sum(p) filter (where i + j > 2) / sum(p) as over25,
  sum(p) filter (where i > 0 and j > 0) / sum(p) as "both", sum(p) filter (where i > 0) / sum(p) as home_scores from grid group by all),
judged as (select *, case y when 0 then home when 1 then draw else away end as hit from (select f.*, m.season, m.home_score, m.away_score, case when home_score > away_score then 0 when home_score = away_score then 1 else 2 end as y
  from forecast f join matches m using (match_id) where status = 'finished')),
picked as (select match_id, market, probability from (select *, row_number() over (partition by match_id order by probability - least_p desc, k) as n from (
  select match_id, unnest([0, 1, 2, 3]) as k, unnest(['home', 'away', 'over25', 'home_scores']) as market, unnest([home, away, over25, home_scores]) as probability, unnest([0.6, 0.6, 0.7, 0.875]) as least_p from forecast) where probability >= least_p) where n = 1),
graded as (select match_id, season, market, probability, case when status = 'postponed' then 'void' when status <> 'finished' then 'pending' when case market when 'home' then home_score > away_score when 'away' then away_score > home_score
  when 'over25' then home_score + away_score > 2 else home_score > 0 end then 'won' else 'lost' end as grade from picked join matches using (match_id))"""
S = lambda body: sql(body, M, TM, STRENGTH)
TAU = "case when home_score = 0 and away_score = 0 then 1 - home_rate * away_rate * rho when home_score = 0 and away_score = 1 then 1 + home_rate * rho when home_score = 1 and away_score = 0 then 1 + away_rate * rho else 1 - rho end"
NAMES = ["home_rate", "away_rate", "home", "draw", "away", "over25", "both", "home_scores"]
LOSS = f"""count(*) as n, {r6("avg(-ln(greatest(hit, 1e-12)))")} as log_loss, {r6("avg(pow(home - (y = 0)::int, 2) + pow(draw - (y = 1)::int, 2) + pow(away - (y = 2)::int, 2))")} as brier, {r6("avg((floor(hit * 1e9 + 0.5) = floor(greatest(home, draw, away) * 1e9 + 0.5))::int)")} as accuracy"""

QUERIES = {
    "ml1_wn24_decayed_strengths": (
        lambda s, d: rounded(m.decayed_strengths(r.team_match(matches(s, d))), "mean_goals", "attack", "defence", "weight"),
        S(f"select match_id, competition_id, team_id, day, is_home, {r6('mean_goals')} as mean_goals, {r6('attack')} as attack, {r6('defence')} as defence, {r6('weight')} as weight from strengths"),
    ),
    "ml3_ml4_ml5_jn21_markets": (lambda s, d: rounded(forecasts(s, d), *NAMES), S("select match_id, " + ", ".join(f'{r6(chr(34) + n + chr(34))} as "{n}"' for n in NAMES) + " from forecast")),
    "ml6_over_closed_form": (
        lambda s, d: expected(s, d).select("match_id", half_up(1 - F.exp(-(c("home_rate") + c("away_rate"))) * (1 + c("home_rate") + c("away_rate") + (c("home_rate") + c("away_rate")) ** 2 / 2), 6).alias("over25")),
        S(f"select match_id, {r6('(1 - exp(-(home_rate + away_rate)) * (1 + home_rate + away_rate + pow(home_rate + away_rate, 2) / 2))')} as over25 from expected"),
    ),
    "ml7_rho": (
        lambda s, d: rounded(m.rho_scores(expected(s, d), matches(s, d), [-0.2, -0.15, -0.1, -0.05, 0.0, 0.05]), "log_likelihood"),
        S(f"""select rho, {r6('sum(ln(greatest(case when home_score = 0 and away_score = 0 then 1 - home_rate * away_rate * rho when home_score = 0 and away_score = 1 then 1 + home_rate * rho when home_score = 1 and away_score = 0 then 1 + away_rate * rho else 1 - rho end, 1e-9)))')} as log_likelihood
  from expected join matches using (match_id), (select cast(unnest([-0.2, -0.15, -0.1, -0.05, 0.0, 0.05]) as double) as rho) where home_score <= 1 and away_score <= 1 group by all"""),
    ),
    "ml7_fitted_rho": (
        lambda s, d: rounded(m.fitted_rho(expected(s, d), matches(s, d)), "rho", "log_likelihood"),
        sql(f"""select {r6('arg_max(rho, ll)')} as rho, {r6('max(ll)')} as log_likelihood from (select rho, sum(ln(greatest({TAU}, 1e-9))) as ll from low, (select arg_max(rho, ll) + (unnest(range(51)) - 25) * (0.0025e0 / 25) as rho from
  (select rho, sum(ln(greatest({TAU}, 1e-9))) as ll from low, (select -0.2e0 + 0.0025e0 * unnest(range(101)) as rho) group by rho)) group by rho)""", M, TM, STRENGTH, "\nlow as (select * from expected join matches using (match_id) where home_score <= 1 and away_score <= 1)"),  # fmt: skip
    ),
    "ml8_wn23_elo": (lambda s, d: ratings.elo(matches(s, d)), None),
    "ml10_national_strengths": (lambda s, d: ratings.national_strengths(matches(s, d)), None),
    "ml12_losses_by_season": (lambda s, d: rounded(m.losses(judged(s, d), "season"), "log_loss", "brier", "accuracy"), S(f"select season, {LOSS} from judged group by all")),
    "ml13_calibration_error": (
        lambda s, d: rounded(m.calibration_error(judged(s, d), c("home"), c("y") == 0), "ece"),
        S(f"select cast(sum(n) as bigint) as n, {r6('sum(n * gap) / sum(n)')} as ece from (select least(floor(home * 10), 9) as bin, count(*) as n, abs(avg(home) - avg((y = 0)::int)) as gap from judged group by all)"),
    ),
    "ml14_auc": (
        lambda s, d: rounded(m.area_under_curve(judged(s, d).withColumn("p", half_up(c("home"), 6)), c("p"), c("y") == 0), "auc"),
        S(f"""select cast(sum(pos) as bigint) as positives, cast(sum(n - pos) as bigint) as negatives, {r6('(sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(n - pos))')} as auc from (select n, pos, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rank
  from (select {r6('home')} as s, count(*) as n, sum((y = 0)::int) as pos from judged group by all))"""),
    ),
    "ml16_ml18_ag25_bands": (
        lambda s, d: m.bands(judged(s, d), c("home"), c("y") == 0, [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]),
        S(f"""select band, n, hits, {r6('mean_p')} as mean_p, {r6('((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))')} as wilson_low from (select *, hits * 1.0e0 / n as p from (
  select cast(case when home >= 0.7 then 0.7 when home >= 0.6 then 0.6 when home >= 0.5 then 0.5 when home >= 0.4 then 0.4 when home >= 0.3 then 0.3 when home >= 0.2 then 0.2 else 0 end as double) as band, count(*) as n, cast(sum((y = 0)::int) as bigint) as hits, avg(home) as mean_p from judged group by all))"""),
    ),
    "ml20_picks": (lambda s, d: rounded(m.picks(forecasts(s, d)), "probability"), S(f"select match_id, market, {r6('probability')} as probability from picked")),
    "ml21_ml23_graded": (lambda s, d: rounded(m.graded(m.picks(forecasts(s, d)), matches(s, d)), "probability"), S(f"select match_id, season, market, {r6('probability')} as probability, grade from graded")),
    "ag24_record": (
        lambda s, d: m.record(m.graded(m.picks(forecasts(s, d)), matches(s, d))),
        S("""select market, season, count(*) filter (where grade = 'won') as won, count(*) filter (where grade = 'lost') as lost, count(*) filter (where grade = 'void') as void, floor(sum(probability) filter (where grade in ('won', 'lost')) * 1e4 + 0.5) / 1e4 as expected
  from graded group by grouping sets ((), (market), (season))"""),
    ),
    "ml17_calibrators": (lambda s, d: rounded(m.calibrator_losses(judged(s, d), "season"), "log_loss"), None),
    "ml24_xt6_missed": (
        lambda s, d: matches(s, d).where("status = 'finished'").select("match_id", "competition_id").join(forecasts(s, d), "match_id", "left_anti"),
        S("select match_id, competition_id from matches where status = 'finished' and match_id not in (select match_id from forecast)"),
    ),
    "ml30_baseline": (
        lambda s, d: rounded(matches(s, d).where("status = 'finished'").groupBy("competition_id").agg(F.avg(F.expr("cast(home_score > away_score as int)")).alias("home"), F.avg(F.expr("cast(home_score = away_score as int)")).alias("draw"), F.avg(F.expr("cast(home_score < away_score as int)")).alias("away")), "home", "draw", "away"),
        S(f"select competition_id, {r6('avg((home_score > away_score)::int)')} as home, {r6('avg((home_score = away_score)::int)')} as draw, {r6('avg((home_score < away_score)::int)')} as away from matches where status = 'finished' group by all"),
    ),
    "ml11_xt17_bias_by_split": (
        lambda s, d: rounded(judged(s, d).groupBy(F.when(c("season") <= 1998, "train").otherwise("holdout").alias("split"), (F.greatest("home", "draw", "away") >= 0.5).alias("clear")).agg(F.count("*").alias("n"), (F.avg("home") - F.avg(F.expr("cast(y = 0 as int)"))).alias("bias")), "bias"),
        S(f"select case when season <= 1998 then 'train' else 'holdout' end as split, greatest(home, draw, away) >= 0.5 as clear, count(*) as n, {r6('(avg(home) - avg((y = 0)::int))')} as bias from judged group by all"),
    ),
}

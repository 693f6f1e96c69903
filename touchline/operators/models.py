"""Forecasts, their evaluation, and the pick ledger."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up, poisson, wilson_low
from .ordered import before

c = F.col
HALF_LIFE = 540.0
#: Goals a side may score in the grid, none to this many.
MOST_GOALS = 10


def decayed_strengths(rows: DataFrame, half_life: float = HALF_LIFE, shrink: float = 10.0, reach: float = 5.0) -> DataFrame:
    """Attack and defence of a team before each of its matches, from earlier days only.

    The weight 2 ** (-(t - s) / H) splits into a factor of t and one of s, so goals are scaled
    once and added up by windows over days; days equal to the match's own stay out of the frame.
    Both windows are first summed by day, so their rows are days, not matches: a frame that moves is
    added up anew for each day, and what it holds must not grow with the matches.
    """
    scaled = rows.withColumn("w", F.pow(F.lit(2.0), (c("day") - 9000) / half_life))
    back = int(reach * half_life)
    frame = lambda *keys: Window.partitionBy(*keys).orderBy("day").rangeBetween(-back, -1)
    days = scaled.groupBy("competition_id", "day").agg(F.sum("w").alias("dw"), F.sum(c("w") * c("gf")).alias("dg"))
    over = frame("competition_id")
    league = days.select("competition_id", "day", F.sum("dw").over(over).alias("lw"), F.sum("dg").over(over).alias("lg"))
    own = frame("competition_id", "team_id")
    own_days = scaled.groupBy("competition_id", "team_id", "day").agg(F.sum("w").alias("dw"), F.sum(c("w") * c("gf")).alias("df"), F.sum(c("w") * c("ga")).alias("da"))
    sums = own_days.select("competition_id", c("team_id").alias("of_team"), "day", F.sum("dw").over(own).alias("tw"), F.sum("df").over(own).alias("tf"), F.sum("da").over(own).alias("ta"))
    known = sums.join(league, ["competition_id", "day"]).withColumnsRenamed({"competition_id": "of_competition", "day": "of_day"})
    decay = F.pow(F.lit(2.0), -(c("day") - 9000) / half_life)
    zero = lambda x: F.coalesce(c(x), F.lit(0.0)) * decay
    joined = rows.join(known, (c("competition_id") == c("of_competition")) & c("team_id").eqNullSafe(c("of_team")) & (c("day") == c("of_day")))
    mean = c("lg") / c("lw")
    rate = lambda x: (zero(x) + shrink * mean) / (zero("tw") + shrink) / mean
    return joined.where("lw > 0 and lg > 0").select("match_id", "competition_id", "team_id", "day", "is_home", mean.alias("mean_goals"), rate("tf").alias("attack"), rate("ta").alias("defence"), zero("tw").alias("weight"))


def rates(strengths: DataFrame) -> DataFrame:
    """Expected goals of both sides of a match."""
    home = strengths.where("is_home").select("match_id", "mean_goals", c("attack").alias("ha"), c("defence").alias("hd"))
    away = strengths.where("not is_home").select("match_id", c("attack").alias("aa"), c("defence").alias("ad"))
    both = home.join(away, "match_id")
    return both.select("match_id", (c("mean_goals") * c("ha") * c("ad")).alias("home_rate"), (c("mean_goals") * c("aa") * c("hd")).alias("away_rate"))


def markets(expected: DataFrame, rho: float = -0.1099) -> DataFrame:
    """Home, draw, away, over 2.5 and both score, from the grid of scorelines with the low-score correction.

    The grid is a product of two rows but for four cells, so its sums come from one walk along both
    rows; no rows are made for scorelines, and no expression for every cell.
    """
    h, a = c("home_rate"), c("away_rate")
    ph = F.array(*[poisson(k, h) for k in range(MOST_GOALS + 1)])
    pa = F.array(*[poisson(k, a) for k in range(MOST_GOALS + 1)])
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(x) for x in ("home", "draw", "away", "sh", "sa")])

    def walk(t: Column, k: Column) -> Column:
        x, y = F.get("ph", k), F.get("pa", k)
        return F.struct((t["home"] + x * t["sa"]).alias("home"), (t["draw"] + x * y).alias("draw"), (t["away"] + y * t["sh"]).alias("away"), (t["sh"] + x).alias("sh"), (t["sa"] + y).alias("sa"))

    staged = expected.select("match_id", "home_rate", "away_rate", ph.alias("ph"), pa.alias("pa"))
    staged = staged.withColumn("t", F.aggregate(F.sequence(F.lit(0), F.lit(MOST_GOALS)), start, walk))
    p = lambda i, j: F.get("ph", F.lit(i)) * F.get("pa", F.lit(j))
    fix = {(0, 0): F.greatest(zero, 1 - h * a * rho), (0, 1): F.greatest(zero, 1 + h * rho), (1, 0): F.greatest(zero, 1 + a * rho), (1, 1): F.lit(1 - rho)}
    # What the correction adds to its four cells.
    d00, d01, d10, d11 = (p(*x) * (f - 1) for x, f in fix.items())
    low = p(0, 0) + p(0, 1) + p(1, 0) + p(1, 1) + p(0, 2) + p(2, 0)
    staged = staged.select("*", d00.alias("d00"), d01.alias("d01"), d10.alias("d10"), d11.alias("d11"), low.alias("low"), F.get("ph", F.lit(0)).alias("h0"), F.get("pa", F.lit(0)).alias("a0"))
    all_d = c("d00") + c("d01") + c("d10") + c("d11")
    sums = staged.select(
        "match_id", "home_rate", "away_rate",
        (c("t.sh") * c("t.sa") + all_d).alias("whole"), (c("t.home") + c("d10")).alias("home"), (c("t.draw") + c("d00") + c("d11")).alias("draw"), (c("t.away") + c("d01")).alias("away"),
        (c("t.sh") * c("t.sa") - c("low")).alias("over25"), ((c("t.sh") - c("h0")) * (c("t.sa") - c("a0")) + c("d11")).alias("both"), ((c("t.sh") - c("h0")) * c("t.sa") + c("d10") + c("d11")).alias("home_scores"),
    )
    share = lambda x: (c(x) / c("whole")).alias(x)
    return sums.select("match_id", "home_rate", "away_rate", *[share(x) for x in ("home", "draw", "away", "over25", "both", "home_scores")])


def rho_scores(expected: DataFrame, matches: DataFrame, grid: list[float]) -> DataFrame:
    """Log likelihood of each correction in a fixed grid, from the four low scores that it changes."""
    low = expected.join(matches.where("home_score <= 1 and away_score <= 1").select("match_id", "home_score", "away_score"), "match_id")
    tried = low.select("*", F.explode(F.array(*[F.lit(x) for x in grid])).alias("rho"))
    h, a, r = c("home_rate"), c("away_rate"), c("rho")
    tau = F.when((c("home_score") == 0) & (c("away_score") == 0), 1 - h * a * r).when((c("home_score") == 0) & (c("away_score") == 1), 1 + h * r).when((c("home_score") == 1) & (c("away_score") == 0), 1 + a * r).otherwise(1 - r)
    return tried.groupBy("rho").agg(F.sum(F.log(F.greatest(tau, F.lit(1e-9)))).alias("log_likelihood"))


def fitted_rho(expected: DataFrame, matches: DataFrame, low: float = -0.2, step: float = 0.0025, steps: int = 100) -> DataFrame:
    """The correction of greatest likelihood: on a coarse grid, then on a fine one around its best. Each grid is one aggregate."""
    best = lambda grid: rho_scores(expected, matches, grid).agg(F.max_by("rho", "log_likelihood").alias("rho"), F.max("log_likelihood").alias("log_likelihood"))
    coarse = best([low + step * k for k in range(steps + 1)]).first()["rho"]
    return best([coarse + (k - 25) * (step / 25) for k in range(51)] if coarse is not None else [0.0])


def scoreline_loss(expected: DataFrame, matches: DataFrame, rho: float = -0.1099) -> DataFrame:
    """Mean negative log probability of the scorelines that came, in the corrected grid."""
    h, a, x, y = c("home_rate"), c("away_rate"), c("home_score"), c("away_score")
    rows = expected.join(matches.where("status = 'finished'").select("match_id", "home_score", "away_score"), "match_id")
    tau = F.when((x == 0) & (y == 0), F.greatest(F.lit(0.0), 1 - h * a * rho)).when((x == 0) & (y == 1), F.greatest(F.lit(0.0), 1 + h * rho)).when((x == 1) & (y == 0), F.greatest(F.lit(0.0), 1 + a * rho)).when((x == 1) & (y == 1), 1 - rho).otherwise(1.0)
    pois = lambda n, rate: F.exp(-rate) * F.pow(rate, n.cast("double")) / F.factorial(n)
    # The grid ends at MOST_GOALS; the four corrected cells add up to what the plain ones had, but for the clamps.
    row = lambda rate: sum((poisson(k, rate) for k in range(MOST_GOALS + 1)), F.lit(0.0))
    cells = {(0, 0): F.greatest(F.lit(0.0), 1 - h * a * rho), (0, 1): F.greatest(F.lit(0.0), 1 + h * rho), (1, 0): F.greatest(F.lit(0.0), 1 + a * rho), (1, 1): F.lit(1 - rho)}
    whole = row(h) * row(a) + sum((poisson(i, h) * poisson(j, a) * (f - 1) for (i, j), f in cells.items()), F.lit(0.0))
    p = pois(x, h) * pois(y, a) * tau / whole
    return rows.select(F.log(F.greatest(p, F.lit(1e-12))).alias("l")).agg(F.count("*").alias("n"), F.sum("l").alias("log_likelihood"), (-F.avg("l")).alias("log_loss"))


def leaks(rows: DataFrame) -> DataFrame:
    """How many rows' league mean changes when earlier rows of the same day count too: the leak that the strict frames avoid."""
    loose = Window.partitionBy("competition_id").orderBy("day", "match_id", "team_id").rowsBetween(Window.unboundedPreceding, -1)
    strict = Window.partitionBy("competition_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    both = rows.select("competition_id", F.avg("gf").over(loose).alias("a"), F.avg("gf").over(strict).alias("b"))
    return both.groupBy("competition_id").agg(F.count("*").alias("n"), F.count_if(~c("a").eqNullSafe(c("b"))).alias("changed"))


def truncation_differences(build, rows: DataFrame, keys: list[str], values: list[str], day: int) -> DataFrame:
    """Rows up to a day whose values change when all later rows are left out: none, for an operator that looks back only.

    ``build`` gets the rows and returns the keys, the day and the values.
    """
    whole, cut = build(rows).where(c("day") <= day), build(rows.where(c("day") <= day))
    both = whole.select(*keys, F.struct(*values).alias("a")).join(cut.select(*keys, F.struct(*values).alias("b")), keys, "full")
    return both.agg(F.count("*").alias("compared"), F.count_if(~c("a").eqNullSafe(c("b"))).alias("different"))


def outcomes(probabilities: DataFrame, matches: DataFrame) -> DataFrame:
    """Forecasts with what happened: 0 home, 1 draw, 2 away."""
    y = F.when(c("home_score") > c("away_score"), 0).when(c("home_score") == c("away_score"), 1).otherwise(2)
    return probabilities.join(matches.where("status = 'finished'").select("match_id", "season", "home_score", "away_score", y.alias("y")), "match_id")


def hit_probability() -> Column:
    return F.when(c("y") == 0, c("home")).when(c("y") == 1, c("draw")).otherwise(c("away"))


def losses(df: DataFrame, *keys: str) -> DataFrame:
    """Log loss, Brier score and accuracy of three-way forecasts."""
    brier = sum(((c(p) - F.when(c("y") == k, 1.0).otherwise(0.0)) ** 2 for k, p in enumerate(("home", "draw", "away"))), F.lit(0.0))
    level = lambda x: F.floor(x * 1e9 + 0.5)  # noqa: E731  probabilities equal but for their last bits tie
    best = F.greatest("home", "draw", "away")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(-F.log(F.greatest(hit_probability(), F.lit(1e-12)))).alias("log_loss"), F.avg(brier).alias("brier"), F.avg((level(hit_probability()) == level(best)).cast("int")).alias("accuracy")
    )


def calibration_error(df: DataFrame, p: Column, hit: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width, the last one closed."""
    each = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"), p.alias("p"), hit.cast("double").alias("hit"))
    by_bin = each.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("hit")).alias("gap"))
    return by_bin.agg(F.sum("n").alias("n"), (F.sum(c("n") * c("gap")) / F.sum("n")).alias("ece"))


def bands(df: DataFrame, p: Column, hit: Column, edges: list[float]) -> DataFrame:
    """Forecasts by probability band: number, mean probability, hit rate, Wilson's lower bound."""
    band = F.lit(None).cast("double")
    for low in edges:
        band = F.when(p >= low, F.lit(low)).otherwise(band)
    each = df.select(band.alias("band"), p.alias("p"), hit.cast("long").alias("hit")).where("band is not null")
    out = each.groupBy("band").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("p").alias("mean_p"))
    return out.select("band", "n", "hits", half_up(c("mean_p"), 6).alias("mean_p"), half_up(wilson_low(c("hits"), c("n")), 6).alias("wilson_low"))


def area_under_curve(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """AUC by the rank sum; equal scores share the mean of their ranks."""
    levels = before(df.select(score.alias("s"), positive.cast("long").alias("y")), "s", {"pos": "y"})
    ranked = levels.select("n", "pos", (c("before_n") + (c("n") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum("pos").alias("p"), F.sum(c("n") - c("pos")).alias("q"), F.sum(c("rank") * c("pos")).alias("r"))
    return sums.select(c("p").alias("positives"), c("q").alias("negatives"), F.try_divide(c("r") - c("p") * (c("p") + 1) / 2, c("p") * c("q")).alias("auc"))


#: Markets in their fixed order, and the least probability at which one is picked.
MARKETS = {"home": 0.6, "away": 0.6, "over25": 0.7, "home_scores": 0.875}


def picks(probabilities: DataFrame) -> DataFrame:
    """One pick a match: the market furthest over its threshold, the earlier market on a tie."""
    offers = F.array(*[F.struct((c(m) - t).alias("margin"), F.lit(-k).alias("order"), F.lit(m).alias("market"), c(m).alias("probability")) for k, (m, t) in enumerate(MARKETS.items())])
    # Filtered after they are rows of their own: a filter on one expression of all markets would be
    # pushed below the grid and repeat it.
    each = probabilities.select("match_id", F.explode(offers).alias("o")).select("match_id", "o.*").where("margin >= 0")
    best = each.groupBy("match_id").agg(F.max(F.struct("margin", "order", "market", "probability")).alias("b"))
    return best.select("match_id", "b.market", "b.probability")


def graded(picked: DataFrame, matches: DataFrame) -> DataFrame:
    """won, lost, void (postponed) or pending, by market."""
    m = matches.select("match_id", "season", "status", "home_score", "away_score")
    hit = F.when(c("market") == "home", c("home_score") > c("away_score")).when(c("market") == "away", c("away_score") > c("home_score")).when(c("market") == "over25", c("home_score") + c("away_score") > 2).otherwise(c("home_score") > 0)
    state = F.when(c("status") == "postponed", "void").when(c("status") != "finished", "pending").when(hit, "won").otherwise("lost")
    return picked.join(m, "match_id").select("match_id", "season", "market", "probability", state.alias("grade"))


def record(grades: DataFrame) -> DataFrame:
    """Wins, losses and expected wins: in total, by market, by season."""
    n = lambda g: F.count_if(c("grade") == g).alias(g)
    return grades.groupingSets([[], [c("market")], [c("season")]], "market", "season").agg(n("won"), n("lost"), n("void"), half_up(F.sum(F.when(c("grade").isin("won", "lost"), c("probability"))), 4).alias("expected")).select("market", "season", "won", "lost", "void", "expected")


#: Calibrators of three-way forecasts: parameters (what they add to the three logits, as a function of
#: the forecast's logits z), what they start from, and logits that are added as they are.
_UNIT = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
CALIBRATORS = {
    "temperature": ([lambda z: z], [1.0], None),
    "bias": ([lambda z: [F.lit(1.0), F.lit(0.0), F.lit(0.0)], lambda z: [F.lit(0.0), F.lit(1.0), F.lit(0.0)]], [0.0, 0.0], "z"),
    "vector": ([*[lambda z, k=k: [z[k] if j == k else F.lit(0.0) for j in range(3)] for k in range(3)], *[lambda z, k=k: [F.lit(_UNIT[k][j]) for j in range(3)] for k in range(2)]], [1.0, 1.0, 1.0, 0.0, 0.0], None),
    "matrix": ([*[lambda z, k=k, m=m: [z[m] if j == k else F.lit(0.0) for j in range(3)] for k in range(3) for m in range(3)], *[lambda z, k=k: [F.lit(_UNIT[k][j]) for j in range(3)] for k in range(2)]], [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0, 0.0, 0.0], None),
}


def cut_off(df: DataFrame) -> DataFrame:
    """The rows as they are now, to be read several times: a reliable checkpoint where the session has a folder for it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def calibrated(df: DataFrame, method: str, fold: str | None = None, steps: int = 6, ridge: float = 1e-3) -> tuple[dict, DataFrame]:
    """Fit a calibrator by Newton steps; with ``fold``, once without the rows of each of its values, for those rows.

    Every step is one aggregate for all folds: the sums of first and second derivatives. Few values
    come to the driver (folds times parameters squared). ``ridge`` pulls parameters to their start,
    in proportion to the rows. Returns the parameters by fold (None: all rows) and the rows with
    calibrated probabilities in cal_home, cal_draw and cal_away.
    """
    makers, start, offset = CALIBRATORS[method]
    logs = [F.log(F.greatest(c(x), F.lit(1e-12))) for x in ("home", "draw", "away")]
    based = df.select("*", *[z.alias(f"z{k}") for k, z in enumerate(logs)])
    z = [c("z0"), c("z1"), c("z2")]
    terms = [m(z) for m in makers]
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()] if fold else [None]
    place = {f: k for k, f in enumerate(folds)}
    theta = np.tile(np.array(start, float), (len(folds), 1))
    n = len(makers)

    def softmax(own: list[Column]) -> list[Column]:
        logits = [sum((own[p] * terms[p][k] for p in range(n)), z[k] if offset else F.lit(0.0)) for k in range(3)]
        top = F.greatest(*logits)
        parts = [F.exp(x - top) for x in logits]
        return [x / (parts[0] + parts[1] + parts[2]) for x in parts]

    def with_parameters(rows: DataFrame, which: Column) -> DataFrame:
        table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in theta])
        return rows.withColumn("theta", F.get(table, which))

    trained = based.withColumn("of", F.explode(F.array(*[F.lit(k) for k in range(len(folds))])))
    if fold:
        of = F.create_map(*[F.lit(x) for f, k in place.items() for x in (f, k)])
        trained = trained.where(F.element_at(of, c(fold)) != c("of"))
    for _ in range(steps):
        q = with_parameters(trained, c("of"))
        probabilities = softmax([F.get("theta", F.lit(p)) for p in range(n)])
        q = q.select("*", *[x.alias(f"q{k}") for k, x in enumerate(probabilities)])
        mean = [sum((c(f"q{k}") * terms[p][k] for k in range(3)), F.lit(0.0)) for p in range(n)]
        told = [F.when(c("y") == 0, terms[p][0]).when(c("y") == 1, terms[p][1]).otherwise(terms[p][2]) for p in range(n)]
        second = [(p, r) for p in range(n) for r in range(p, n)]
        sums = q.groupBy("of").agg(
            F.count("*").alias("n"),
            *[F.sum(mean[p] - told[p]).alias(f"g{p}") for p in range(n)],
            *[F.sum(sum((c(f"q{k}") * terms[p][k] * terms[r][k] for k in range(3)), F.lit(0.0)) - mean[p] * mean[r]).alias(f"h{p}_{r}") for p, r in second],
        )
        for row in sums.collect():
            pull = ridge * row["n"] if n > 5 else 1e-9 * row["n"]
            hessian = np.zeros((n, n))
            for p, r in second:
                hessian[p, r] = hessian[r, p] = row[f"h{p}_{r}"]
            own = theta[row["of"]]
            gradient = np.array([row[f"g{p}"] for p in range(n)]) + pull * (own - start)
            theta[row["of"]] = own - np.linalg.solve(hessian + pull * np.eye(n), gradient)
    which = F.element_at(F.create_map(*[F.lit(x) for f, k in place.items() for x in (f, k)]), c(fold)) if fold else F.lit(0)
    out = with_parameters(based, which)
    final = softmax([F.get("theta", F.lit(p)) for p in range(n)])
    out = out.select(*df.columns, *[x.alias(f"cal_{name}") for x, name in zip(final, ("home", "draw", "away"))])
    return {f: theta[k].tolist() for f, k in place.items()}, out


def calibrator_losses(df: DataFrame, fold: str) -> DataFrame:
    """Log loss of each calibrator, fitted without and scored on each season in turn, and of none; the best one is chosen."""
    rows = cut_off(df)
    loss = lambda d, names: d.agg(F.avg(-F.log(F.greatest(F.when(c("y") == 0, c(names[0])).when(c("y") == 1, c(names[1])).otherwise(c(names[2])), F.lit(1e-12)))).alias("log_loss"))
    out = loss(rows, ("home", "draw", "away")).select(F.lit("none").alias("method"), "log_loss")
    for method in CALIBRATORS:
        _, scored = calibrated(rows, method, fold)
        out = out.unionByName(loss(scored, ("cal_home", "cal_draw", "cal_away")).select(F.lit(method).alias("method"), "log_loss"))
    return out.withColumn("chosen", c("log_loss") == F.min("log_loss").over(Window.partitionBy(F.lit(1))))

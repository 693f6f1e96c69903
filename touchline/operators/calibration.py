"""What a calibrator does to the order of forecasts: ranks, favourites, and the most confident ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from .crosschecks import confident_accuracy
from .ordered import before

c = F.col
CLASSES = ("home", "draw", "away")
SHARES = (0.1, 0.2)


def _favourite(tag: str):
    most = F.greatest(*[c(f"{tag}_{x}") for x in CLASSES])
    return F.when(c(f"{tag}_home") == most, 0).when(c(f"{tag}_draw") == most, 1).otherwise(2)


def ranking(df: DataFrame) -> DataFrame:
    """Rank agreement of raw and calibrated probabilities by class, over all rows: class, d_auc, spearman.

    df: match_id, y, raw_<class>, cal_<class>. The six columns are one pass: their values are counted in
    six pools, and each distinct value gets its middle rank and the outcomes below it.
    """
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.lit(t).alias("of"), c(f"{t}_{x}").alias("v")) for k, x in enumerate(CLASSES) for t in ("raw", "cal")])).alias("s")
    long = df.select("match_id", "y", told).select("match_id", "s.*", (c("y") == c("s.class")).cast("long").alias("hit"))
    levels = before(long, "v", {"hits": "hit"}, pool=("class", "of"))
    whole = levels.groupBy("class", "of").agg(F.sum("hits").alias("p"), F.sum(c("n") - c("hits")).alias("q"), F.sum(c("hits") * (c("before_n") - c("before_hits") + (c("n") - c("hits")) / 2.0)).alias("won"))
    auc = whole.groupBy("class").agg(*[F.max(F.when(c("of") == t, F.try_divide(c("won"), c("p") * c("q")))).alias(f"{t}_auc") for t in ("raw", "cal")])
    rank = levels.select("class", "of", "v", (c("before_n") + (c("n") + 1) / 2.0).alias("rank"))
    ranked = long.join(rank, ["class", "of", "v"]).groupBy("class", "match_id").agg(*[F.max(F.when(c("of") == t, c("rank"))).alias(t) for t in ("raw", "cal")])
    return auc.join(ranked.groupBy("class").agg(F.corr("raw", "cal").alias("spearman")), "class").select("class", half_up(c("cal_auc") - c("raw_auc"), 5).alias("d_auc"), half_up(c("spearman"), 5).alias("spearman"))


def ordering(df: DataFrame) -> DataFrame:
    """One row: favourites that change, and the change of accuracy of favourites and of the most confident shares."""
    named = df.select("match_id", "y", *[_favourite(t).alias(f"{t}_favourite") for t in ("raw", "cal")], *[F.greatest(*[c(f"{t}_{x}") for x in CLASSES]).alias(f"{t}_most") for t in ("raw", "cal")])
    accuracy = lambda t: F.avg((c(f"{t}_favourite") == c("y")).cast("double"))
    out = named.agg(F.count("*").alias("n"), F.count_if(c("raw_favourite") != c("cal_favourite")).alias("changes"), half_up(accuracy("cal") - accuracy("raw"), 6).alias("d_favourite"))
    tops = {t: confident_accuracy(named.select(c("match_id").alias("id"), c(f"{t}_most").alias("p"), (c(f"{t}_favourite") == c("y")).alias("hit")), list(SHARES)).select("share", c("accuracy").alias(t)) for t in ("raw", "cal")}
    top = tops["raw"].join(tops["cal"], "share").agg(*[half_up(F.max(F.when(c("share") == s, c("cal") - c("raw"))), 6).alias(f"d_top{int(s * 100)}") for s in SHARES])
    return out.join(top)  # one row each


def order_kept(df: DataFrame) -> DataFrame:
    """One row with the measures of ``ranking`` and ``ordering``, and whether rules K5 and K6 hold."""
    ranks = ranking(df).agg(F.max(F.abs("d_auc")).alias("most_d_auc"), F.min("spearman").alias("least_spearman"))
    both = ordering(df).join(ranks)
    k5 = (c("most_d_auc") < 0.005) & (c("least_spearman") >= 0.99)
    k6 = (c("changes") <= 0.02 * c("n")) & (F.abs("d_favourite") < 0.01) & (c("d_top10") >= -0.02) & (c("d_top20") >= -0.02)
    return both.withColumns({"k5": F.coalesce(k5, F.lit(False)), "k6": F.coalesce(k6, F.lit(False))})

"""Decisions with reasons: identities, listings, formats, video links, slugs, issue of forecasts, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fold, half_up, slug, wilson_low
from ..sources.shared import written

c = F.col


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for rule, reason in reversed(rules):
        out = F.when(rule, F.lit(reason)).otherwise(out)
    return out


def corroborated(athletes: DataFrame, candidates: DataFrame, windows: DataFrame, clubs: DataFrame) -> DataFrame:
    """Whether a provider's athlete is a stored player: merge, or queue with the reason.

    athletes: (athlete_id, name, born, country); candidates: (player_id, name, born, country, other_id);
    windows: (player_id, season, team_id) observed clubs; clubs: (athlete_id, season, team_id) the provider's.
    One candidate by folded name and birth day; no other id of the provider; no other country where both
    state one; at least one season with a club in common, and none with another.
    """
    # Candidates are counted by name and birth day before they are met, so namesakes make no pairs.
    own = candidates.select("player_id", fold(c("name")).alias("key"), "born", c("country").alias("p_country"), "other_id")
    named = own.groupBy("key", "born").agg(F.count("*").alias("k"), F.min(F.struct("player_id", "p_country", "other_id")).alias("first"))
    met = athletes.select("athlete_id", fold(c("name")).alias("key"), "born", c("country").alias("a_country")).join(named, ["key", "born"])
    n = met.groupBy("athlete_id").agg(F.sum("k").alias("n"), F.min(F.struct("first.player_id", "a_country", "first.p_country", "first.other_id")).alias("m")).select("athlete_id", "n", "m.*")
    clubs_of = windows.groupBy("player_id", "season").agg(F.collect_set("team_id").alias("teams"))
    seasons = n.where("n = 1").select("athlete_id", "player_id").join(clubs, "athlete_id").join(clubs_of, ["player_id", "season"])
    seen = seasons.groupBy("athlete_id").agg(F.count_if(F.array_contains("teams", c("team_id"))).alias("same"), F.count_if(~F.array_contains("teams", c("team_id"))).alias("different"))
    both = athletes.select("athlete_id").join(n, "athlete_id", "left").join(seen, "athlete_id", "left")
    reason = first_reason(
        (c("n").isNull(), "no_candidate"), (c("n") > 1, "multiple_candidates"), (c("other_id").isNotNull() & (c("other_id") != c("athlete_id")), "contradiction_provider_id"),
        (F.coalesce(c("a_country") != c("p_country"), F.lit(False)), "contradiction_nationality"), (F.coalesce(c("different") > 0, F.lit(False)), "contradiction_club"), (F.coalesce(c("same"), F.lit(0)) == 0, "no_club_in_common"),
    )
    return both.select("athlete_id", F.when(reason.isNull(), c("player_id")).alias("player_id"), F.when(reason.isNull(), "merge").otherwise("queue").alias("decision"), reason.alias("reason"))


def guarded(crosswalk: DataFrame, teams: DataFrame, competitions: DataFrame) -> DataFrame:
    """Crosswalked teams that a competition may not use: clubs among national teams, another gender.

    crosswalk: (external_id, competition_id, team_id); teams: (team_id, team_type, gender); competitions: (competition_id, national, gender).
    """
    both = crosswalk.join(teams.select("team_id", "team_type", c("gender").alias("team_gender")), "team_id").join((competitions.select("competition_id", "national", c("gender").alias("wanted"))), "competition_id")
    reason = first_reason((c("national") & (c("team_type") != "national"), "club_in_national_competition"), (c("team_gender") != c("wanted"), "gender_differs"))
    return both.select("external_id", "competition_id", "team_id", reason.alias("reason")).where("reason is not null")


def listings(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Listings of one pair in a season: real matches, replaced listings and unclear ones: (listing_id, season, home, away, day, status, home_score, away_score).

    Of listings within ``reach`` days of an earlier one (finished ones come first): not finished, replaced;
    finished on another day with another result, a match of its own; else unclear. Unfinished listings of
    a pair that has a finished one are replaced as well.
    """
    keys = ["season", "home", "away"]
    done = (c("status") == "finished").cast("int")
    order = Window.partitionBy(*keys).orderBy(F.desc("done"), "day", "listing_id")
    ranked = rows.withColumn("done", done).withColumn("k", F.row_number().over(order)).withColumn("finished", F.sum("done").over(Window.partitionBy(*keys)))
    # An earlier listing is met through the days around it.
    near = ranked.select(*[c(x).alias(f"o_{x}") for x in (*keys, "k", "day", "done", "home_score", "away_score")]).withColumn("o_near", F.explode(F.sequence(c("o_day") - reach, c("o_day") + reach)))
    met = ranked.join(near, [c(x) == c(f"o_{x}") for x in keys] + [c("day") == c("o_near"), c("o_k") < c("k")], "left")
    distinct = (c("o_done") == 1) & (c("o_day") != c("day")) & ((c("o_home_score") != c("home_score")) | (c("o_away_score") != c("away_score")))
    sums = met.groupBy("listing_id", "done", "finished").agg(F.count("o_k").alias("others"), F.count_if(c("o_k").isNotNull() & ~F.coalesce(distinct, F.lit(False))).alias("same"))
    verdict = F.when((c("others") > 0) & (c("done") == 0), "replaced").when((c("same") > 0), "unclear").when((c("done") == 0) & (c("finished") > 0), "replaced").otherwise("match")
    return sums.select("listing_id", verdict.alias("verdict"))


def reviewed_format(matches: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Stage of each match of a season by reviewed play-off fixtures: (fixture_id, day, team_a, team_b, goals_a, goals_b).

    A fixture names exactly one finished match of its two teams and goals, on its day or the day after;
    several or none leave it unmatched, and its matches among the league's.
    """
    pair = lambda a, b: [F.least(c(a), c(b)).alias("t1"), F.greatest(c(a), c(b)).alias("t2")]
    goals = lambda a, b, x, y: [F.when(c(a) < c(b), c(x)).otherwise(c(y)).alias("g1"), F.when(c(a) < c(b), c(y)).otherwise(c(x)).alias("g2")]
    done = matches.where("status = 'finished'").select("match_id", "day", *pair("home_team_id", "away_team_id"), *goals("home_team_id", "away_team_id", "home_score", "away_score"))
    wanted = reviewed.select("fixture_id", F.explode(F.array(c("day"), c("day") + 1)).alias("day"), *pair("team_a", "team_b"), *goals("team_a", "team_b", "goals_a", "goals_b"))
    met = wanted.join(done, ["day", "t1", "t2", "g1", "g2"]).select("fixture_id", "match_id").distinct()
    one = met.groupBy("fixture_id").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id")).where("n = 1").groupBy("match_id").agg(F.min("fixture_id").alias("fixture_id"))
    out = matches.join(one, "match_id", "left")
    stage = F.when(c("fixture_id").isNotNull(), "playoff").when(c("status") == "finished", "league")
    return out.select("match_id", "competition_id", "season", "home_team_id", "away_team_id", "fixture_id", stage.alias("stage"))


def league_games(staged: DataFrame) -> DataFrame:
    """Matches of each team in the league stage."""
    sides = staged.where("stage = 'league'").select("competition_id", "season", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return sides.groupBy("competition_id", "season", "team_id").agg(F.count("*").alias("games"))


def slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """A free slug for each entity: (entity, name, year); the plain one, with the year, or with the start of its id.

    Who comes first by id has the plain slug. Every step is a rank within one slug, so entities of
    other names never wait for each other; what is taken is left out by an anti join.
    """
    base = names.select("entity", F.when(slug(c("name")) == "", "unnamed").otherwise(slug(c("name"))).alias("base"), "year")
    tries = base.select(
        "entity",
        F.posexplode(F.array(c("base"), F.concat_ws("-", "base", c("year").cast("string")), F.concat_ws("-", c("base"), F.substring(F.md5(c("entity").cast("string")), 1, 6)), F.concat_ws("-", "base", F.md5(c("entity").cast("string"))))).alias("k", "slug"),
    )
    left = tries.join(taken.select("slug").distinct(), "slug", "left_anti")
    done = None
    for k in range(4):
        here = left.where(c("k") == k)
        if done is not None:
            here = here.join(done, "entity", "left_anti").join(done.select("slug"), "slug", "left_anti")
        won = here.groupBy("slug").agg(F.min("entity").alias("entity"))
        done = written(won if done is None else done.unionByName(won), "slugs")  # read twice by the next step
    return done.select("entity", "slug")


def display_name(first: Column, last: Column, short: Column) -> Column:
    """The short name if it has a full first name, else first and last, else what there is."""
    known = lambda x: F.when(F.trim(x) != "", F.trim(x))
    full = F.concat_ws(" ", known(first), known(last))
    return F.coalesce(F.when(~known(short).rlike(r"^\w\. "), known(short)), known(full), known(short), F.lit("unknown"))


#: What a video's title and day say for an article, and what against it.
VIDEO_POINTS = {"both teams": 40, "one team": 15, "same day": 20, "near day": 10, "score": 25, "highlights": 10, "other team": -50}
VIDEO_LEAST = 75


def video_links(videos: DataFrame, articles: DataFrame) -> DataFrame:
    """The best article of each video, by points and vetoes: videos (video_id, day, kind, teams, score); articles (article_id, day, home, away, score).

    Pairs meet by a shared team and by days at most three apart.
    """
    named = videos.withColumn("team", F.explode("teams")).withColumn("near", F.explode(F.sequence(c("day") - 3, c("day") + 3)))
    about = articles.select("article_id", c("day").alias("a_day"), "home", "away", c("score").alias("a_score"), F.explode(F.array("home", "away")).alias("a_team"))
    met = named.join(about, (c("team") == c("a_team")) & (c("near") == c("a_day"))).select("video_id", "article_id", "day", "a_day", "kind", "teams", "score", "a_score", "home", "away").distinct()
    p = VIDEO_POINTS
    both = F.array_contains("teams", c("home")) & F.array_contains("teams", c("away"))
    others = F.size(F.array_except("teams", F.array("home", "away"))) > 0
    points = (
        F.when(both, p["both teams"]).otherwise(p["one team"]) + F.when(c("day") == c("a_day"), p["same day"]).when(F.abs(c("day") - c("a_day")) == 1, p["near day"]).otherwise(0)
        + F.when(c("score") == c("a_score"), p["score"]).otherwise(0) + F.when(c("kind") == "highlights", p["highlights"]).otherwise(0) + F.when(others, p["other team"]).otherwise(0)
    )
    veto = first_reason((others, "other team"), (~both & c("score").isNull(), "one team without a score"), (F.coalesce(c("score") != c("a_score"), F.lit(False)), "other score"))
    scored = met.select("video_id", "article_id", points.cast("long").alias("points"), veto.alias("veto"))
    best = scored.where("veto is null").groupBy("video_id").agg(F.max(F.struct("points", -c("article_id"))).alias("b"), F.count("*").alias("candidates"))
    return best.select("video_id", F.when(c("b.points") >= VIDEO_LEAST, -c("b.col2")).alias("article_id"), c("b.points").alias("points"), "candidates")


def subjects(entities: DataFrame) -> DataFrame:
    """Primary subject of each article: marked, else a person in the headline, else a team in it, else the first entity: (id, place, type, entity, marked, in_headline)."""
    rank = F.when(c("marked"), 0).when((c("type") == "Person") & c("in_headline"), 1).when((c("type") == "SportsTeam") & c("in_headline"), 2).otherwise(3)
    reason = F.element_at(F.array(*[F.lit(x) for x in ("marked", "person in headline", "team in headline", "class default")]), rank + 1)
    first = Window.partitionBy("id").orderBy(rank, "place", "entity", "type")
    return entities.select("id", "type", "entity", reason.alias("reason"), F.row_number().over(first).alias("k")).where("k = 1").drop("k")


def agreed_media(items: DataFrame) -> DataFrame:
    """Whether an outside record may give a player's picture: (player_id, born, item_born, is_human, ids, own_id, images)."""
    reason = first_reason(
        (~c("is_human"), "not_human"), (c("item_born").isNull() | (c("born") != c("item_born")), "birth_date"), (F.size(F.filter("ids", lambda x: x != c("own_id"))) > 0, "other_provider_id"), (F.size("images") != 1, "images")
    )
    return items.select("player_id", reason.isNull().alias("agrees"), reason.alias("reason"))


def conditional_update(df: DataFrame, where: Column | None, changes: dict[str, Column]) -> DataFrame:
    """The rows with changed columns where the condition holds; a missing condition is refused, never taken as "all"."""
    if where is None:
        raise ValueError("an update needs a condition")
    if not changes:
        raise ValueError("an update needs changes")
    unknown = set(changes) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, changes[x]).otherwise(c(x)).alias(x) if x in changes else c(x) for x in df.columns], hit.alias("updated"))


def by_precedence(observations: DataFrame) -> DataFrame:
    """A match's latest values from its owner; observers' values are counted beside them and never written: (match_id, owner, source, home_score, away_score, at)."""
    latest = observations.groupBy("match_id", "owner", "source").agg(F.max_by(F.struct("home_score", "away_score"), "at").alias("s"))
    own = F.max(F.when(c("source") == c("owner"), c("s")))
    sums = latest.groupBy("match_id").agg(own.alias("w"), F.count_if(c("source") != c("owner")).alias("observers"), F.collect_set(F.when(c("source") != c("owner"), c("s"))).alias("seen"))
    differs = F.size(F.filter("seen", lambda x: ~x.eqNullSafe(c("w")))).cast("long")
    return sums.select("match_id", c("w.home_score").alias("home_score"), c("w.away_score").alias("away_score"), "observers", F.when(c("w").isNotNull(), differs).otherwise(0).alias("disagreements"))


def issue(fixtures: DataFrame, forecasts: DataFrame, past: DataFrame, now: int, window: int = 7, lock: int = 1) -> DataFrame:
    """Which scheduled matches may get a forecast now: issue, or hold with the reason; those with one already are left out.

    fixtures: (match_id, competition_id, day, status); past: (competition_id, day, status, home_score) of all matches.
    Any earlier match without its result holds the whole competition; a fixture is out of reach before the
    window, and locked ``lock`` days before kickoff.
    """
    gone = F.count_if((c("day") < now) & ~c("status").isin("postponed", "cancelled", "abandoned") & ((c("status") != "finished") | c("home_score").isNull()))
    open_ = past.groupBy("competition_id").agg(gone.alias("missing"), F.max(F.when((c("status") == "finished") & (c("day") < now), c("day"))).alias("input_as_of"))
    due = fixtures.where((c("status") == "scheduled") & (c("day") - lock >= now) & (c("day") <= now + window)).join(forecasts.select("match_id", F.lit(True).alias("issued")), "match_id", "left").where("issued is null")
    both = due.join(open_, "competition_id", "left")
    reason = first_reason((c("missing") > 0, "prior_result_unavailable"), (c("input_as_of").isNull(), "no_time_safe_inputs"))
    return both.select("match_id", "competition_id", F.when(reason.isNull(), "issue").otherwise("hold").alias("decision"), reason.alias("reason"), "input_as_of")


def frozen_members(matches: DataFrame, frozen: DataFrame, frozen_at: int) -> DataFrame:
    """Matches that a frozen data set lets into a model: those it lists, and those after it was frozen."""
    return matches.join(frozen.select("match_id", F.lit(True).alias("listed")), "match_id", "left").where(c("listed") | (c("day") > frozen_at)).select("match_id", F.coalesce("listed", F.lit(False)).alias("listed"))


#: Acceptance of a pick policy: picks, hit rate, lower bound, seasons and their worst hit rate.
GATES = {"E0": "n >= 30", "E1": "hit_rate >= 0.5", "E2": "wilson_low >= 0.45", "E3": "hit_rate >= mean_probability - 0.05", "E4": "seasons >= 2", "E5": "worst >= 0.4"}


def policy_statistics(offers: DataFrame, thresholds: list[float], gates: dict[str, str] = GATES) -> DataFrame:
    """Statistics and gates of every market at every threshold: offers (market, season, probability, hit).

    All thresholds are counted in one pass over the offers, first by season.
    """
    tried = offers.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("probability >= threshold")
    by_season = tried.groupBy("market", "threshold", "season").agg(F.count("*").alias("n"), F.sum(c("hit").cast("int")).alias("hits"), F.sum("probability").alias("p"))
    sums = by_season.groupBy("market", "threshold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("p").alias("p"), F.count("*").alias("seasons"), F.min(c("hits") / c("n")).alias("worst"))
    shown = sums.select("market", "threshold", "n", "hits", half_up(c("hits") / c("n"), 6).alias("hit_rate"), half_up(c("p") / c("n"), 6).alias("mean_probability"), half_up(wilson_low(c("hits"), c("n")), 6).alias("wilson_low"), "seasons", half_up(c("worst"), 6).alias("worst"))
    failed = F.array_join(F.filter(F.array(*[F.when(~F.expr(p), F.lit(g)) for g, p in gates.items()]), lambda x: x.isNotNull()), ",")
    return shown.select("*", failed.alias("failed"), (failed == "").alias("eligible"))


#: What a policy has to show on seasons that its choice has not seen.
HOLDOUT = {
    "H0": "log_loss < base_log_loss and brier < base_brier",
    "H1": "n > 0 and hit_rate >= mean_probability - 0.04",
    "H2": "wilson_low >= 0.5",
    "H3": "hit_rate - base_rate >= 0.08",
    "H4": "n >= 20",
    "H5": "weak_seasons = 0",
}


def holdout_rules(offers: DataFrame, thresholds: dict[str, float], rules: dict[str, str] = HOLDOUT, least: int = 10) -> DataFrame:
    """Each market's policy at its threshold over held-out seasons: figures, the rules that fail, and whether it is active.

    offers: (market, season, probability, hit, base), base the probability without a model. All offers of
    a market count for H0; picks are those from the threshold on. A season of ``least`` picks or more
    is weak if its hit rate is more than a tenth below its mean probability. One pass, first by season.
    """
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    tried = offers.withColumn("threshold", F.try_element_at(limit, c("market"))).where("threshold is not null").withColumn("picked", c("probability") >= c("threshold"))
    loss = lambda p: -F.log(F.greatest(F.when(c("hit"), p).otherwise(1 - p), F.lit(1e-12)))
    square = lambda p: (p - c("hit").cast("int")) ** 2
    chosen = lambda x: F.coalesce(F.sum(F.when(c("picked"), x)), F.lit(0))
    by_season = tried.groupBy("market", "threshold", "season").agg(
        F.count("*").alias("rows"), F.count_if("picked").alias("n"), chosen(c("hit").cast("int")).alias("hits"), chosen(c("probability")).alias("p"), chosen(c("base")).alias("b"),
        *[F.sum(f(c(x))).alias(f"{k}{name}") for x, k in (("probability", ""), ("base", "base_")) for name, f in (("log_loss", loss), ("brier", square))],
    )
    weak = F.count_if((c("n") >= least) & (half_up(c("hits") / c("n"), 4) < half_up(c("p") / c("n"), 4) - 0.10))
    sums = by_season.groupBy("market", "threshold").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("p").alias("p"), F.sum("b").alias("b"), weak.alias("weak_seasons"), *[F.sum(x).alias(x) for x in ("log_loss", "brier", "base_log_loss", "base_brier")])
    per = lambda a, n: half_up(F.try_divide(c(a), c(n)), 4)
    low = F.when(c("n") > 0, half_up(wilson_low(c("hits"), F.greatest(c("n"), F.lit(1))), 4))
    shown = sums.select("market", "threshold", "n", "hits", per("hits", "n").alias("hit_rate"), per("p", "n").alias("mean_probability"), per("b", "n").alias("base_rate"), low.alias("wilson_low"), "weak_seasons", *[per(x, "rows").alias(x) for x in ("log_loss", "brier", "base_log_loss", "base_brier")])
    failed = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(g)) for g, p in rules.items()]), lambda x: x.isNotNull()), ",")
    return shown.select("*", failed.alias("failed"), (failed == "").alias("active"))


def ordered_logit(df: DataFrame, x: Column, steps: list[tuple[float, float, float]]) -> DataFrame:
    """Log loss of an ordered logit on x at every (slope, lower cut, gap) of a grid: rows with y 0 home, 1 draw, 2 away.

    All points of the grid are counted in one pass; x is rounded and counted first, so that rows meet
    the grid once for each distinct (x, y).
    """
    sig = lambda v: 1 / (1 + F.exp(-v))
    distinct = df.select(x.alias("x"), "y").groupBy("x", "y").agg(F.count("*").alias("n"))
    grid = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("c1"), F.lit(float(b + g)).alias("c2")) for a, b, g in steps])
    tried = distinct.withColumn("g", F.explode(grid)).select("x", "y", "n", "g.*")
    away, upto = sig(c("c1") - c("a") * c("x")), sig(c("c2") - c("a") * c("x"))
    p = F.when(c("y") == 0, 1 - upto).when(c("y") == 1, F.greatest(F.lit(1e-12), upto - away)).otherwise(away)
    losses = tried.groupBy("a", "c1", "c2").agg((F.sum(-F.log(F.greatest(p, F.lit(1e-12))) * c("n")) / F.sum("n")).alias("log_loss"))
    return losses.select("a", half_up(c("c1"), 6).alias("c1"), half_up(c("c2"), 6).alias("c2"), half_up(c("log_loss"), 6).alias("log_loss"))


def never_lower(old: DataFrame, new: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """Merge of a state that may rise and never fall: the higher of the old and the new one, by the order given."""
    rank = lambda x: F.array_position(F.array(*[F.lit(s) for s in order]), x)
    both = old.select(key, c(column).alias("old")).join(new.select(key, c(column).alias("new")), key, "full")
    lower = F.coalesce(rank(c("new")) < rank(c("old")), F.lit(False))
    return both.select(key, F.when(lower | c("new").isNull(), c("old")).otherwise(c("new")).alias(column), lower.alias("refused"))


def refused_issues(forecasts: DataFrame, matches: DataFrame, now: int) -> DataFrame:
    """Forecasts that may not be written, with the reason: (forecast_id, match_id, kickoff, issued, input_as_of)."""
    both = forecasts.join(matches.select("match_id", "status", c("day").alias("day")), "match_id", "left")
    reason = first_reason(
        (c("status").isNull(), "unknown match"), (c("status") != "scheduled", "not scheduled"), (c("kickoff") != c("day"), "other kickoff"), (c("issued") > now, "future dated"), (c("issued") >= c("kickoff"), "after kickoff"), (c("input_as_of") >= c("issued"), "inputs not before issue")
    )
    return both.select("forecast_id", "match_id", reason.alias("reason")).where("reason is not null")


def incomplete_rights(media: DataFrame) -> DataFrame:
    """Approved media whose rights are not complete: (media_id, status, licence, attribution, source, reviewed_by)."""
    missing = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.trim(c(x)), F.lit("")) == "", F.lit(x)) for x in ("licence", "attribution", "source", "reviewed_by")]), lambda x: x.isNotNull()), ",")
    return media.where("status = 'approved'").select("media_id", missing.alias("missing")).where("missing <> ''")


def shadow_metrics(judged: DataFrame, baseline: list[float]) -> DataFrame:
    """Losses, calibration and rates of forecasts, overall, by season and by month, beside a baseline: rows with home, draw, away, y, season, month."""
    y = [F.when(c("y") == k, 1.0).otherwise(0.0) for k in range(3)]
    names = ("home", "draw", "away")
    own = F.when(c("y") == 0, c("home")).when(c("y") == 1, c("draw")).otherwise(c("away"))
    base = F.element_at(F.array(*[F.lit(float(p)) for p in baseline]), (c("y") + 1).cast("int"))
    loss = lambda p: F.avg(-F.log(F.greatest(p, F.lit(1e-12))))
    sets = judged.select("y", *names, "season", "month").groupingSets([[], [c("season")], [c("month")]], "season", "month")
    out = sets.agg(
        F.count("*").alias("n"), loss(own).alias("log_loss"), F.avg(sum(((c(p) - t) ** 2 for p, t in zip(names, y)), F.lit(0.0))).alias("brier"), loss(base).alias("base_log_loss"),
        *[F.avg(c(p)).alias(f"{p}_predicted") for p in names], *[F.avg(t).alias(f"{p}_observed") for p, t in zip(names, y)],
    )
    shown = [x for x in out.columns if x not in ("season", "month", "n")]
    return out.select("season", "month", "n", *[half_up(c(x), 4).alias(x) for x in shown])

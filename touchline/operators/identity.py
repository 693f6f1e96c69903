"""Identity across providers: fixture proofs, interval joins, votes, standings, brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def near_days(a: DataFrame, b: DataFrame, keys: list[str], day_a: str, day_b: str, reach: int = 1) -> DataFrame:
    """Pairs with equal keys whose days differ by ``reach`` at most.

    The rows of ``b`` are put into each day that they may meet, so the join is an equi-join on
    keys and day, however many rows a key has.
    """
    spread = b.withColumn("near_day", F.explode(F.sequence(c(day_b) - reach, c(day_b) + reach))).alias("b")
    met = a.alias("a").join(spread, [c(f"a.{k}") == c(f"b.{k}") for k in keys] + [c(f"a.{day_a}") == c("b.near_day")])
    return met.select(*[c(f"a.{x}") for x in a.columns], *[c(f"b.{x}") for x in b.columns if x not in keys])


def fixture_proof(canonical: DataFrame, provider: DataFrame, keys: tuple[str, ...] = (), least: int = 3, reach: int = 1) -> DataFrame:
    """Match provider teams to canonical teams by their fixtures: (keys, day, home, away) in both, teams by id or name.

    Fixtures meet within their keys (competition and season), side and day only. A candidate must
    cover every fixture of the provider team, on the same side within ``reach`` days. Proven: one
    candidate, which proves one provider team only, with ``least`` fixtures.
    """
    keys = list(keys)
    sides = lambda df, tag: df.select(*keys, F.posexplode(F.array("home", "away")).alias("side", f"{tag}_team"), c("day").alias(f"{tag}_day"))
    # A team's days on a side, once each: what a day's other matches repeat covers nothing more.
    mine, theirs = sides(canonical, "canonical").distinct(), sides(provider, "provider").distinct()
    total = theirs.groupBy(*keys, "provider_team").agg(F.count_if(c("side").isNotNull() & c("provider_day").isNotNull()).alias("fixtures"))
    near = mine.select(*keys, "side", "canonical_team", F.explode(F.sequence(c("canonical_day") - reach, c("canonical_day") + reach)).alias("provider_day")).distinct()
    met = theirs.join(near, [*keys, "side", "provider_day"])
    cover = met.groupBy(*keys, "provider_team", "canonical_team").agg(F.count("*").alias("covered"))
    full = cover.join(total, [*keys, "provider_team"]).where("covered = fixtures")
    # Taken together: how many candidates each side has.
    full = full.withColumn("claims", F.count("*").over(Window.partitionBy(*keys, "canonical_team")))
    one = full.groupBy(*keys, "provider_team").agg(F.count("*").alias("candidates"), F.min("canonical_team").alias("canonical_team"), F.max("claims").alias("claims"))
    out = total.join(one, [*keys, "provider_team"], "left")
    verdict = F.when(c("candidates").isNull(), "contradicted").when(c("fixtures") < least, "thin").when((c("candidates") > 1) | (c("claims") > 1), "ambiguous").otherwise("proven")
    return out.select(*keys, "provider_team", "fixtures", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.when(verdict == "proven", c("canonical_team")).alias("canonical_team"), verdict.alias("verdict"))


def minute_votes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Align scorers by goals: candidates of a match and side within two minutes, 45 up to 52, 90 and later together.

    A provider's scorer is aligned if all its votes name one player.
    """
    m, t = c("minute"), c("their_minute")
    near = F.when(t == 45, m.between(44, 52)).when(t >= 90, m >= 89).otherwise(F.abs(m - t) <= 2)
    both = theirs.join(ours, ["match_id", "team_id"]).where(near)
    goals = both.groupBy("match_id", "team_id", "their_minute", "scorer").agg(F.count_distinct("player_id").alias("n"), F.min("player_id").alias("player_id"))
    votes = goals.where("n = 1").groupBy("scorer").agg(F.count_distinct("player_id").alias("named"), F.min("player_id").alias("player_id"), F.count("*").alias("votes"))
    return votes.select("scorer", "votes", "named", F.when(c("named") == 1, c("player_id")).alias("player_id"))


def tolerant_attach(listings: DataFrame, stored: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """Attach a listing where exactly one stored row of its keys lies within ``reach`` days; else missing or ambiguous."""
    met = near_days(listings, stored, keys, "listed_day", "day", reach)
    n = met.groupBy("listing_id").agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"))
    out = listings.select("listing_id").join(n, "listing_id", "left")
    state = F.when(c("n").isNull(), "missing").when(c("n") == 1, "attached").otherwise("ambiguous")
    return out.select("listing_id", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), F.when(state == "attached", c("match_id")).alias("match_id"), state.alias("state"))


def earlier_days(*keys: str):
    """The rows of a key on days before a row's own."""
    return Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)


def latest_before(rows: DataFrame) -> DataFrame:
    """As-of join of a team's matches with its latest win of an earlier day, by a window instead of a join."""
    won = F.max(F.when(c("points") == 3, F.struct("day", "match_id"))).over(earlier_days("team_id"))
    return rows.select("match_id", "team_id", "day", won["match_id"].alias("last_win"))


def verified(computed: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Compare a source's standings with computed ones by group: different counts, repeated ranks, verdict."""
    fields = ["played", "won", "drawn", "lost", "gf", "ga", "points"]
    theirs = source.select(*keys, "team_id", "position", *[c(f).alias(f"their_{f}") for f in fields])
    both = computed.select(*keys, "team_id", *fields).join(theirs, [*keys, "team_id"], "full")
    same = F.lit(True)
    for f in fields:
        same = same & c(f).eqNullSafe(c(f"their_{f}"))
    out = both.groupBy(*keys).agg(F.count_if(~same).alias("different"), (F.count("position") - F.count_distinct("position")).alias("repeated_ranks"), F.count("*").alias("n_teams"))
    return out.withColumn("verified", (c("different") == 0) & (c("repeated_ranks") == 0))


def feeders(knockout: DataFrame, *keys: str) -> DataFrame:
    """Bracket edges by ``keys``: for both teams of a match, the latest match of an earlier day, if the team won it.

    An edge holds only where both feeders are known and differ.
    """
    sides = knockout.select(*keys, "match_id", "day", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "winner")
    fed = sides.withColumn("feeder", F.max(F.struct("day", "match_id", (c("winner") == c("team_id")).alias("won"))).over(earlier_days(*keys, "team_id")))
    both = fed.groupBy("match_id").agg(F.count_if(F.col("feeder.won")).alias("won"), F.min("feeder.match_id").alias("feeder_a"), F.max("feeder.match_id").alias("feeder_b"))
    return both.where("won = 2 and feeder_a <> feeder_b").select("match_id", "feeder_a", "feeder_b")


def queue(reports: DataFrame) -> DataFrame:
    """Identity queue: the first reason of each entity is kept, later ones are listed after it."""
    return reports.groupBy("entity").agg(F.min_by("reason", "at").alias("first_reason"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count("*").alias("reports"))


def acceptance(matches: DataFrame) -> DataFrame:
    """Invariants of each season on its own: competition_id, season, check, failures, passed; a season with a failure is held.

    Row checks are one aggregate; checks of keys count groups, each by one shuffle of its keys.
    """
    season = ["competition_id", "season"]
    m = matches.where("status = 'finished'")
    bad = {
        "scores present": "home_score is null or away_score is null",
        "scores in range": "home_score not between 0 and 30 or away_score not between 0 and 30",
        "two different teams": "home_team_id = away_team_id",
        "season fits the day": "season <> year(kickoff_at)",
        "kickoff present": "kickoff_at is null",
        "teams present": "home_team_id is null or away_team_id is null",
        "day fits the kickoff": "day <> datediff(cast(kickoff_at as date), date '1970-01-01')",
    }
    rows = matches.groupBy(*season).agg(*[F.count_if(F.expr(f"status = 'finished' and ({p})")).alias(k) for k, p in bad.items()], (F.count_if(c("status") == "finished") == 0).cast("long").alias("any match"))
    rows = rows.unpivot(season, [*bad, "any match"], "check", "failures")
    sides = F.array(F.struct(c("home_team_id").alias("t"), F.lit(1).alias("h")), F.struct(c("away_team_id").alias("t"), F.lit(0).alias("h")))
    per_team = m.select(*season, F.explode(sides).alias("s")).groupBy(*season, "s.t").agg(F.count("*").alias("n"), F.sum("s.h").alias("home"))
    whole = {"balanced": F.max("n") > F.min("n"), "four teams or more": F.count("*") < 4, "as many matches at home as away": F.max(F.abs(2 * c("home") - c("n"))) > 1}
    of_teams = per_team.groupBy(*season).agg(*[x.cast("long").alias(k) for k, x in whole.items()]).unpivot(season, list(whole), "check", "failures")
    twice = lambda name, rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.array_distinct(F.collect_set(F.struct(*season))).alias("of")]).where("n > 1").select(F.explode("of").alias("s")).groupBy("s.competition_id", "s.season").agg(F.count("*").alias("failures")).select(*season, F.lit(name).alias("check"), "failures")
    keyed = {
        "unique ids": twice("unique ids", m, "match_id"),
        "one listing per pair and day": twice("one listing per pair and day", m, "home_team_id", "away_team_id", "day"),
        "one match per pair": twice("one match per pair", m, *season, "home_team_id", "away_team_id"),
        # A team that plays in two competitions of a year counts against both.
        "one competition per team": twice("one competition per team", per_team, "season", "t"),
    }
    out = rows.unionByName(of_teams)
    for name, found in keyed.items():
        out = out.unionByName(rows.select(*season).distinct().join(found, season, "left").select(*season, F.lit(name).alias("check"), F.coalesce("failures", F.lit(0)).cast("long").alias("failures")))
    return out.select(*season, "check", "failures", (c("failures") == 0).alias("passed"))

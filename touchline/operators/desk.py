"""The news desk and the live lane as relations: readiness, gates, feeds, media, snapshots, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import attacking, half_up
from .decisions import first_reason

c = F.col


def recap_ready(matches: DataFrame, components: DataFrame, now: int) -> DataFrame:
    """ready, awaiting_enrichment or too_soon, from a match's components: (match_id, kickoff), (match_id, status, retry_at), times in hours."""
    sums = components.groupBy("match_id").agg(F.max((c("status").isin("unavailable", "empty") & c("retry_at").isNotNull()).cast("int")).alias("retrying"), F.min(c("status").isin("complete", "not_applicable").cast("int")).alias("whole"))
    both = matches.join(sums, "match_id", "left")
    age = F.lit(now) - c("kickoff")
    state = F.when((c("retrying") == 1) & (age < 6), "awaiting_enrichment").when(c("whole") == 1, "ready").when(age >= 2, "ready").otherwise("too_soon")
    return both.select("match_id", state.alias("state"))


def previews(fixtures: DataFrame, table: DataFrame, runs: DataFrame, now: int, ahead: int, k: int = 3) -> DataFrame:
    """Previews worth writing of scheduled matches in the window, the k best of each competition: angles by place and runs.

    fixtures: (match_id, competition_id, day, home_team_id, away_team_id, status); table: (competition_id, team_id, position, played); runs: (team_id, winning, unbeaten, losing).
    """
    window = fixtures.where((c("status") == "scheduled") & c("day").between(now + 1, now + ahead))
    side = lambda t, tag: t.select(*[c(x).alias(x if x == "competition_id" else f"{tag}_{x}") for x in t.columns])
    placed = window
    for tag in ("home", "away"):
        placed = placed.join(side(table, tag), ["competition_id", f"{tag}_team_id"], "left").join(side(runs, tag), f"{tag}_team_id", "left")
    known = (c("home_played") >= 3) & (c("away_played") >= 3)
    pts = lambda rule, w: F.when(F.coalesce(rule, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    score = pts(known & (c("home_position") <= 4) & (c("away_position") <= 4), 1.0)
    for s in ("home", "away"):
        score = score + pts(known & (c(f"{s}_position") == 1), 0.6) + F.when(c(f"{s}_winning") >= 3, 0.5).when(c(f"{s}_unbeaten") >= 6, 0.4).otherwise(0.0) + pts(c(f"{s}_losing") >= 3, 0.4)
    scored = placed.select("match_id", "competition_id", "day", half_up(score, 2).alias("score")).where("score >= 1.0")
    order = Window.partitionBy("competition_id").orderBy(F.desc("score"), "day", "match_id")
    return scored.withColumn("place", F.row_number().over(order)).where(c("place") <= k)


def matchday_briefs(fixtures: DataFrame, now: int, ahead: int, least: int = 3) -> DataFrame:
    """Days of a competition with enough scheduled matches for a brief, and its weight."""
    due = fixtures.where((c("status") == "scheduled") & c("day").between(now + 1, now + ahead)).groupBy("competition_id", "day").agg(F.count("*").alias("fixtures")).where(c("fixtures") >= least)
    return due.withColumn("weight", F.least(F.lit(1.6), 1.0 + 0.1 * c("fixtures")))


def group_watch(results: DataFrame, standings: DataFrame, least: int = 6) -> DataFrame:
    """Weeks of a competition's season with enough results whose standings are verified: (competition_id, season, week, match_id), (competition_id, season, verified)."""
    weeks = results.groupBy("competition_id", "season", "week").agg(F.count("*").alias("results")).where(c("results") >= least)
    return weeks.join(standings.where("verified").select("competition_id", "season"), ["competition_id", "season"], "left_semi")


def unknown_entities(articles: DataFrame, packets: DataFrame) -> DataFrame:
    """Entities that an article names otherwise than its packet, or that the packet doesn't know: (id, entity, name) both."""
    known = packets.select("id", "entity", c("name").alias("told")).distinct()
    return articles.join(known, ["id", "entity"], "left").groupBy("id").agg(F.count("*").alias("named"), F.count_if(~c("name").eqNullSafe(c("told"))).alias("unknown")).withColumn("passes", c("unknown") == 0)


#: Claims that are read from a text: a pattern with one number, and the packet's field that it must equal.
CLAIMS = {"matches": r"last (\d+) league matches", "goals_for": r"scoring (\d+)", "goals_against": r"conceding (\d+)", "run": r"scored in (\d+) (?:straight|consecutive)", "gap": r"lead [^.]* by (\d+) points?"}


def wrong_claims(articles: DataFrame, packets: DataFrame, claims: dict[str, str] = CLAIMS) -> DataFrame:
    """Claims of an article that its packet contradicts or doesn't have: (id, text), (id, one column for each claim)."""
    both = articles.join(packets, "id")
    each = F.array(*[F.struct(F.lit(k).alias("claim"), F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: x.cast("long")).alias("said"), c(k).cast("long").alias("told")) for k, p in claims.items()])
    rows = both.select("id", F.explode(each).alias("x")).select("id", "x.*").where(F.size("said") > 0)
    wrong = F.filter("said", lambda x: ~x.eqNullSafe(c("told")))
    return rows.select("id", "claim", F.size("said").cast("long").alias("said"), F.size(wrong).cast("long").alias("wrong")).where("wrong > 0")


def article_checks(articles: DataFrame) -> DataFrame:
    """Gates of form: (id, headline, text, paragraphs, home_score, away_score, goals): which ones fail."""
    high, low = F.greatest("home_score", "away_score").cast("string"), F.least("home_score", "away_score").cast("string")
    rules = {
        "score_in_headline": F.contains("headline", F.concat_ws("-", high, low)) | F.contains("headline", F.concat_ws("-", c("home_score").cast("string"), c("away_score").cast("string"))),
        "goals_match_score": c("goals") == c("home_score") + c("away_score"),
        "not_thin": c("paragraphs") >= 3,
        "headline_length": F.length("headline").between(20, 110),
        "no_artifact": ~c("text").rlike(r"undefined|\bnull\b|NaN|\[object"),
    }
    failed = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return articles.select("id", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passes"))


def values_hash(values: Column) -> Column:
    """SHA-256 of an ordered list of values as text."""
    return F.sha2(F.array_join(F.transform(values, lambda v: v.cast("string")), "|"), 256)


def changed_charts(charts: DataFrame, values: DataFrame) -> DataFrame:
    """Charts whose values, in order, no longer have the hash they were frozen with: (chart_id, frozen), (chart_id, place, value)."""
    now = values.groupBy("chart_id").agg(values_hash(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])).alias("hash"))
    return charts.join(now, "chart_id", "left").where(~c("hash").eqNullSafe(c("frozen"))).select("chart_id")


def shot_map(events: DataFrame) -> DataFrame:
    """Shots with a place, both sides attacking the same goal."""
    x, y = attacking(c("x_m"), c("y_m"), c("team_id") == c("home_team_id"))
    return events.where("event_type = 'shot' and x_m is not null").select("match_id", "sequence", half_up(x, 1).alias("x"), half_up(y, 1).alias("y"), F.when(c("is_goal"), "goal").when(c("outcome") == "success", "saved").otherwise("off").alias("result"))


def feed(articles: DataFrame, entities: DataFrame, entity: int, k: int = 20) -> DataFrame:
    """The newest published articles that name an entity: (id, status, day), (id, entity)."""
    about = entities.where(c("entity") == entity).select("id").distinct()
    return articles.where("status = 'published'").join(about, "id", "left_semi").orderBy(F.desc("day"), F.desc("id")).limit(k).select("id", "day")


def desk_health(articles: DataFrame, now: int) -> DataFrame:
    """Publication of each desk: of the last 1, 7 and 30 days, held ones, and days since the last: (desk, status, day)."""
    done = lambda d: F.count_if((c("status") == "published") & (c("day") > now - d) & (c("day") <= now)).alias(f"published_{d}")
    sums = articles.where(c("day") <= now).groupBy("desk").agg(done(1), done(7), done(30), F.count_if(c("status") == "held").alias("held"), F.max(F.when(c("status") == "published", c("day"))).alias("last"))
    quiet = F.lit(now) - c("last")
    return sums.select("desk", "published_1", "published_7", "published_30", "held", quiet.alias("quiet_days"), F.when(c("last").isNull() | (quiet > 7), "silent").when(c("held") > c("published_30"), "holding").otherwise("healthy").alias("health"))


def translations(articles: DataFrame, translated: DataFrame) -> DataFrame:
    """Whether a translation is of the article's present revision: (id, revision), (id, locale, of_revision, verified)."""
    both = translated.join(articles.select("id", "revision"), "id", "left")
    state = F.when(c("revision").isNull(), "orphan").when(c("of_revision") != c("revision"), "outdated").when(~c("verified"), "unverified").otherwise("current")
    return both.select("id", "locale", state.alias("state"))


def secondary_view(canonical: DataFrame, enrichment: DataFrame, now: int, fresh: int = 5) -> DataFrame:
    """What is shown of a live match: fresh enrichment, else the stored state: (match_id, status, home_score, away_score), (match_id, e_status, e_home, e_away, observed_at)."""
    both = canonical.join(enrichment, "match_id", "left")
    new = F.coalesce((F.lit(now) - c("observed_at")).between(0, fresh), F.lit(False)) & (c("status") != "finished")
    pick = lambda a, b: F.when(new, c(a)).otherwise(c(b)).alias(b)
    return both.select("match_id", pick("e_status", "status"), pick("e_home", "home_score"), pick("e_away", "away_score"), F.when(new, "enrichment").otherwise("canonical").alias("source"))


def availability(videos: DataFrame) -> DataFrame:
    """Where a video may be shown: (video_id, embeddable, blocked, allowed), regions as arrays or null."""
    blocked = F.coalesce(F.array_contains("blocked", "US"), F.lit(False)) | F.coalesce(~F.array_contains("allowed", "US"), F.lit(False))
    state = F.when(~F.coalesce("embeddable", F.lit(True)), "unembeddable").when(blocked, "blocked_us").when(c("embeddable"), "embeddable").otherwise("unverified")
    return videos.select("video_id", state.alias("state"))


def video_feed(videos: DataFrame, k: int = 4, per_channel: int = 2) -> DataFrame:
    """Videos for a desk: linked ones first, then the newest, at most so many of a channel: (desk, video_id, channel, day, linked)."""
    order = [F.desc("linked"), F.desc("day"), F.desc("video_id")]
    own = Window.partitionBy("desk", "channel").orderBy(*order)
    kept = videos.withColumn("k", F.row_number().over(own)).where(c("k") <= per_channel)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("desk").orderBy(*order))).where(c("place") <= k).select("desk", "video_id", "channel", "place")


#: Types of videos in the order in which an article shows them; others come after.
VIDEO_TYPES = ("highlights", "goals", "match_recap")
FULL_CUT = 120


def article_videos(links: DataFrame, videos: DataFrame, channels: DataFrame, k: int = 2, offered: int = 10) -> DataFrame:
    """The videos of each article, strongest link first: (article_id, video_id, score), (video_id, channel, type, seconds, embeddable, short, live), (channel).

    Of an article's ``offered`` best links those to videos that may be embedded, of known channels, are
    shown; equal scores go by type, full cuts before clips, then the shorter one, then the id.
    """
    best = Window.partitionBy("article_id").orderBy(F.desc("score"), "video_id")
    near = links.withColumn("k", F.row_number().over(best)).where(c("k") <= offered)
    able = videos.where(~c("embeddable").eqNullSafe(False) & ~F.coalesce("short", F.lit(False)) & ~F.coalesce("live", F.lit(False))).join(channels.select("channel"), "channel", "left_semi")
    rank = F.array_position(F.array(*[F.lit(t) for t in VIDEO_TYPES]), F.coalesce("type", F.lit("")))
    order = Window.partitionBy("article_id").orderBy(F.desc("score"), F.when(rank > 0, rank).otherwise(len(VIDEO_TYPES) + 1), F.coalesce(c("seconds") >= FULL_CUT, F.lit(False)).desc(), c("seconds").asc_nulls_last(), "video_id")
    shown = near.select("article_id", "video_id", "score").join(able, "video_id").withColumn("place", F.row_number().over(order))
    return shown.where(c("place") <= k).select("article_id", "video_id", "place", "score")


def sitemap(articles: DataFrame, translated: DataFrame, k: int = 1000) -> DataFrame:
    """The newest published articles as address keys, with their last change and the locales of current translations.

    articles: (id, desk, slug, status, published, updated, revision); translated: (id, locale, of_revision, verified). A
    translation is current if it is verified and of the article's revision.
    """
    newest = articles.where("status = 'published'").orderBy(F.desc("published"), F.desc("id")).limit(k)
    current = newest.select("id", "revision").join(translated.where("verified"), "id").where(c("of_revision") == c("revision"))
    locales = current.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("locale")), ",").alias("locales"))
    return newest.join(locales, "id", "left").select(F.concat_ws("/", "desk", "slug").alias("key"), F.coalesce("updated", "published").alias("updated"), "published", F.coalesce("locales", F.lit("")).alias("locales"))


def relinked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of videos after a new round of scores: the better one stays, the old one on a tie; a link whose video scores no more is withdrawn: (video_id, article_id, points) both."""
    both = old.select("video_id", c("article_id").alias("o"), c("points").alias("op")).join(new.select("video_id", c("article_id").alias("n"), c("points").alias("np")), "video_id", "full")
    better = F.coalesce(c("np") > c("op"), c("op").isNull())
    action = F.when(c("n").isNull(), "withdrawn").when(c("o").isNull(), "linked").when(better & (c("n") != c("o")), "moved").otherwise("kept")
    return both.select("video_id", F.when(action == "withdrawn", F.lit(None)).when(better, c("n")).otherwise(c("o")).cast("long").alias("article_id"), action.alias("action"))


#: Lines about coverage, which each run writes anew.
COVERAGE_LINE = r"^(lineups|team statistics|event record) for \d+% of finished matches$"


def limitations(existing: Column, additions: Column, coverage: Column) -> Column:
    """Reviewed notes stay, coverage lines are replaced, each line once, in order."""
    kept = lambda x: F.filter(x, lambda line: ~line.rlike(COVERAGE_LINE))
    return F.array_distinct(F.concat(kept(existing), kept(additions), coverage))


def neutral_sites(matches: DataFrame, captures: DataFrame) -> DataFrame:
    """Whether a match was on neutral ground, by its latest capture: (match_id), (match_id, at, body as JSON)."""
    latest = captures.groupBy("match_id").agg(F.max_by("body", "at").alias("body"))
    flag = F.get_json_object("body", "$.neutralSite").cast("boolean")
    return matches.select("match_id").join(latest, "match_id", "left").select("match_id", F.coalesce(flag, F.lit(False)).alias("neutral"), c("body").isNotNull().alias("captured"))


def related_media(media: DataFrame) -> DataFrame:
    """One approved medium for each entity and type: the primary, then the newest: (entity, type, media_id, status, is_primary, day)."""
    order = Window.partitionBy("entity", "type").orderBy(F.desc("is_primary"), F.desc("day"), "media_id")
    return media.where("status = 'approved'").withColumn("k", F.row_number().over(order)).where("k = 1").select("entity", "type", "media_id")


def group_context(table: DataFrame, standings: DataFrame, teams: DataFrame) -> DataFrame:
    """A team's place in its verified table, for a packet; nothing where the table isn't verified."""
    ok = table.join(standings.where("verified").select("competition_id", "season"), ["competition_id", "season"], "left_semi")
    sized = ok.withColumn("teams_in_group", F.count("*").over(Window.partitionBy("competition_id", "season")))
    return sized.join(teams.select("team_id"), "team_id", "left_semi").select("competition_id", "season", "team_id", "position", "teams_in_group", "points", "played")


def first_seen(reads: DataFrame) -> DataFrame:
    """When each play was first published, and first missing after its last read: (match_id, play_id, read_at)."""
    times = reads.select("match_id", "read_at").distinct()
    after = times.select("match_id", c("read_at").alias("last_seen"), F.lead("read_at").over(Window.partitionBy("match_id").orderBy("read_at")).alias("withdrawn_seen"))
    plays = reads.groupBy("match_id", "play_id").agg(F.min("read_at").alias("first_seen"), F.max("read_at").alias("last_seen"))
    return plays.join(after, ["match_id", "last_seen"]).select("match_id", "play_id", "first_seen", "withdrawn_seen")


def disagreements(reads: DataFrame, patience: int = 10) -> DataFrame:
    """Score differences that lasted: one row when a pair of scores has differed for ``patience`` minutes: (match_id, at, theirs, ours)."""
    order = Window.partitionBy("match_id").orderBy("at")
    pair = F.when(~c("theirs").eqNullSafe(c("ours")), F.concat_ws("|", "theirs", "ours"))
    marked = reads.withColumn("pair", pair).withColumn("fresh", F.when(c("pair").eqNullSafe(F.lag("pair").over(order)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = runs.withColumn("since", F.min("at").over(Window.partitionBy("match_id", "run"))).where("pair is not null")
    return since.where(c("at") - c("since") >= patience).groupBy("match_id", "pair", "since").agg(F.min("at").alias("logged_at"))


def final_reconciliation(matches: DataFrame, reads: DataFrame) -> DataFrame:
    """An observer's last score against the owner's final one, once the owner has finished the match: (match_id, status, home_score, away_score), (match_id, at, home, away)."""
    last = reads.groupBy("match_id").agg(F.max_by(F.struct("home", "away"), "at").alias("seen"))
    agree = c("seen.home").eqNullSafe(c("home_score")) & c("seen.away").eqNullSafe(c("away_score"))
    return matches.join(last, "match_id").select("match_id", F.when(c("status") != "finished", "waiting").when(agree, "agrees").otherwise("differs").alias("result"))


def snapshot_policy(snapshots: DataFrame, now: int) -> DataFrame:
    """Why a snapshot is to be built anew, and whether it may be served: (snapshot_id, built_at, dirty_at, live, near), seconds."""
    age = F.when(c("built_at").isNotNull(), F.greatest(F.lit(0), F.lit(now) - c("built_at")))
    active = c("live") | c("near")
    why = first_reason(
        (c("built_at").isNull(), "missing"), (F.coalesce(c("dirty_at") > c("built_at"), F.lit(False)), "ingest_dirty"), (c("live") & (age >= 55), "live_active"), (c("near") & (age >= 55), "kickoff_near"), (age >= 900, "idle_safety")
    )
    return snapshots.select("snapshot_id", why.alias("refresh"), F.coalesce(age <= F.when(active, 180).otherwise(1200), F.lit(False)).alias("serveable"))


def tick_metrics(ticks: DataFrame, keep: int = 120) -> DataFrame:
    """Median and 95th percentile (nearest rank) of a lane's last ticks: (lane, at, ms)."""
    newest = Window.partitionBy("lane").orderBy(F.desc("at"))
    last = ticks.withColumn("k", F.row_number().over(newest)).where(c("k") <= keep)
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy("ms", "at"))).withColumn("n", F.count("*").over(Window.partitionBy("lane")))
    at = lambda q: F.max(F.when(c("r") == F.greatest(F.lit(1), F.ceil(F.lit(q) * c("n"))), c("ms")))
    return ranked.groupBy("lane").agg(F.count("*").alias("ticks"), at(0.5).alias("median"), at(0.95).alias("p95"))


def to_poll(tokens: DataFrame, stored: DataFrame) -> DataFrame:
    """Matchdays whose change token differs from the stored one: (season, matchday, token) both."""
    return tokens.join(stored.select("season", "matchday", c("token").alias("old")), ["season", "matchday"], "left").where(~c("token").eqNullSafe(c("old"))).select("season", "matchday", "token")


def late_rules(picks: DataFrame, matches: DataFrame, now: int, moved: int = 48, recap: int = 8) -> DataFrame:
    """Picks whose match moved by more than ``moved`` hours are void, and recaps are due within ``recap`` hours: (pick_id, match_id, kickoff), (match_id, status, starts), hours."""
    both = picks.join(matches, "match_id", "left")
    state = F.when(c("starts").isNull(), "unknown").when(F.abs(c("starts") - c("kickoff")) > moved, "void").when(c("status") == "finished", "settle").otherwise("pending")
    return both.select("pick_id", "match_id", state.alias("state"), F.coalesce((c("status") == "finished") & (F.lit(now) - c("starts")).between(0, recap), F.lit(False)).alias("recap_due"))


def enveloped(data: DataFrame, key: str, source: str, observed: str, now: int, fresh: int) -> DataFrame:
    """Rows as JSON with provenance, freshness and coverage beside them."""
    body = F.to_json(F.struct(*[c(x) for x in data.columns if x != observed]))
    age = F.lit(now) - c(observed)
    coverage = F.when(F.size(F.filter(F.array(*[c(x).cast("string") for x in data.columns if x != observed]), lambda v: v.isNull())) == 0, "complete").otherwise("partial")
    return data.select(c(key), body.alias("data"), F.lit(source).alias("source"), age.alias("age"), F.when(age.isNull(), "unknown").when(age <= fresh, "fresh").otherwise("stale").alias("freshness"), coverage.alias("coverage"))


#: A provider's roster file.
ROSTER = "struct<rosters: array<struct<homeAway: string, team: struct<id: string>, roster: array<struct<starter: boolean, jersey: string, subbedIn: boolean, athlete: struct<id: string, displayName: string>, stats: array<struct<name: string, value: double>>>>>>>"


def roster_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rows of roster files in JSON, one for each player; players without an id and broken files give none."""
    sides = bodies.select("match_id", F.explode(F.from_json(c(body), ROSTER)["rosters"]).alias("s"))
    people = sides.select("match_id", c("s.homeAway").alias("side"), c("s.team.id").alias("team"), F.explode("s.roster").alias("p"))
    stat = lambda name: F.get(F.filter("p.stats", lambda x: x["name"] == name), F.lit(0))["value"]
    return people.where("p.athlete.id is not null").select("match_id", "side", "team", c("p.athlete.id").alias("player"), c("p.athlete.displayName").alias("name"), F.coalesce("p.starter", F.lit(False)).alias("starter"), F.coalesce("p.subbedIn", F.lit(False)).alias("came_on"), c("p.jersey").cast("int").alias("shirt"), stat("totalGoals").cast("long").alias("goals"))


def video_entries(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Entries of video feeds in XML: (channel), one row for each entry with an id."""
    tag = lambda name: rf"(?s)<{name}>(.*?)</{name}>"
    entries = feeds.select("channel", F.explode(F.regexp_extract_all(c(body), F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    one = lambda name: F.trim(F.regexp_extract("e", tag(name), 1))
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return entries.select("channel", one("yt:videoId").alias("video_id"), plain(one("title")).alias("title"), one("published").alias("published")).where("video_id <> ''")


def keep_calibrator(raw: DataFrame, seasons: DataFrame, order: DataFrame) -> DataFrame:
    """Whether a calibrator is kept: (method, d_log_loss, d_brier, d_ece, lowest, highest, draw_low, draw_high, shift), (method, season, d_log_loss), (method, k5, k6) of ``order_kept``.

    A rule of which a measure is missing fails.
    """
    worse = seasons.groupBy("method").agg(F.count_if(c("d_log_loss") > 0.002).alias("worse"))
    spread = (c("lowest") >= 0.02) & (c("highest") <= 0.95) & (c("draw_low") >= 0.05) & (c("draw_high") <= 0.45) & (c("shift") <= 0.10)
    rules = {"K1": c("d_log_loss") <= -0.0005, "K2": c("d_brier") <= 0.0005, "K3": c("d_ece") < 0, "K4": c("worse") <= 1, "K5": c("k5"), "K6": c("k6"), "K7": spread}
    failed = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull()), ",")
    return raw.join(worse, "method").join(order.select("method", "k5", "k6"), "method", "left").select("method", "worse", failed.alias("failed"), (failed == "").alias("kept"))

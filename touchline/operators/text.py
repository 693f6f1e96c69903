"""Text gates and matching: numbers, phrases, aliases, entities, related articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fold, numbers
from ..sources.shared import written

c = F.col

#: Phrases that an article may not use, by rule.
BANNED: dict[str, str] = {
    "unsupported_quote": r"""(?i)[“”"]|\b(said|says|told reporters|admitted|insisted|according to)\b""",
    "unsupported_medical": r"(?i)\b(injur\w*|hamstring|knock|fitness doubt|ruled out|sidelined|concussion|suspended|suspension)\b",
    "unsupported_transfer": r"(?i)\b(transfer|rumou?r\w*|linked with|bid for|signing target|contract talks)\b",
    "unsupported_market": r"(?i)\b(odds|bet(s|ting)?|wager|spread|moneyline|bookmaker|sportsbook|value pick|lock of)\b",
    "unsupported_record": r"(?i)\b(record|first time|all-time|historic\w*|best ever|worst ever|unprecedented)\b",
    "unsupported_mentality": r"(?i)\b(wanted it more|hungr\w*|lacked desire|mentality|bottled|choked|confiden\w*|frustrat\w*|pressure mounts)\b",
    "unpublished_metric": r"(?i)\b(xg|expected goals|xt|expected threat|possession value|field tilt|ppda)\b",
    "unsupported_possession": r"(?i)\bpossession\b",
    "cliche": r"(?i)\b(game of two halves|at the end of the day|showed their class|statement win|put on a clinic)\b",
}


def ungrounded_numbers(articles: DataFrame, packets: DataFrame) -> DataFrame:
    """Numbers that an article states and its packet doesn't: (id, text) both; an article passes without any."""
    stated = articles.select("id", numbers(c("text")).alias("stated"))
    given = packets.select("id", numbers(c("text")).alias("given"))
    both = stated.join(given, "id", "left")
    missing = F.array_except("stated", F.coalesce("given", F.array().cast("array<string>")))
    return both.select("id", F.size("stated").cast("long").alias("stated"), F.size(missing).cast("long").alias("missing"), (F.size(missing) == 0).alias("passes"))


def phrase_hits(texts: DataFrame, rules: dict[str, str] = BANNED) -> DataFrame:
    """Rules that a text breaks, in the rules' order; texts that break none are left out."""
    found = F.filter(F.array(*[F.when(c("text").rlike(p), F.lit(name)) for name, p in rules.items()]), lambda x: x.isNotNull())
    return texts.select("id", F.array_join(found, ",").alias("rules"), F.size(found).cast("long").alias("n")).where("n > 0")


def tokens(text: Column) -> Column:
    """Distinct folded words."""
    return F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != ""))


#: What a shared entity counts for, by its type; and the bonus for articles of one desk and for near days.
ENTITY_WEIGHTS = {"Person": 60, "SportsEvent": 40, "SportsTeam": 26}
DESK_BONUS, LEAST_SCORE = 4, 26
#: Articles whose pairs one task makes.
PART_ARTICLES = 4000


def related(articles: DataFrame, entities: DataFrame, k: int = 4, latest: int = 200) -> DataFrame:
    """For each article the k of the ``latest`` published ones that are most related to it.

    articles: (id, desk, day); entities: (id, type, entity). The score is the weight of all shared
    entities, with a bonus for one desk and for days near each other; below LEAST_SCORE nothing is
    related. Only the latest articles are offered (as in a feed), so an entity that very many
    articles name meets at most so many others, and none is left out.
    """
    spark = articles.sparkSession
    offered = written(articles.orderBy(F.desc("day"), F.desc("id")).limit(latest).select(c("id").alias("other"), c("desk").alias("other_desk"), c("day").alias("other_day")), "offered")
    weights = F.create_map(*[F.lit(x) for kv in ENTITY_WEIGHTS.items() for x in kv])
    # At most ``latest`` articles' entities are on this side.
    theirs = written(entities.select(c("id").alias("other"), "type", "entity").join(F.broadcast(offered.select("other")), "other").distinct(), "offered")
    # What an article shares is dealt by article once; its pairs are made, summed and ranked where they are.
    # The number of parts follows the articles, as a part grows by ``latest`` when its pairs are made.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), articles.count() // PART_ARTICLES)
    named = entities.join(F.broadcast(theirs.select("type", "entity").distinct()), ["type", "entity"], "left_semi").repartition(parts, "id").dropDuplicates(["id", "type", "entity"])
    named = named.withColumn("weight", F.coalesce(F.element_at(weights, c("type")), F.lit(0)))
    shared = named.join(F.broadcast(theirs), ["type", "entity"]).where("id <> other").groupBy("id", "other").agg(F.sum("weight").alias("shared"))
    both = shared.join(F.broadcast(offered), "other").join(articles, "id")
    days = F.abs(c("day") - c("other_day"))
    score = c("shared") + F.when(c("desk") == c("other_desk"), DESK_BONUS).otherwise(0) + F.when(days <= 1, 12).when(days <= 3, 9).when(days <= 7, 6).otherwise(0)
    scored = both.select("id", "other", score.cast("long").alias("score"), "other_day").where(c("score") >= LEAST_SCORE)
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("other_day"), F.desc("other"))
    return scored.withColumn("place", F.row_number().over(order)).where(c("place") <= k).select("id", "other", "score", "place")


#: Words of a club's name that are no part of its core name.
CLUB_WORDS = ("fc", "sc", "cf", "afc", "ac", "club", "the")


def alias_index(names: DataFrame, other_names: DataFrame | None = None) -> DataFrame:
    """Aliases that name one entity only: (entity, name, short), and further names (entity, alias).

    Forms: the full and the short name, the name without club words, further names, and every word
    of four letters or more; each folded, and kept only where a single entity has it.
    """
    words = lambda x: F.filter(F.split(fold(x), "[^a-z0-9]+"), lambda w: w != "")
    plain = lambda x: F.array_join(words(x), " ")
    core = F.array_join(F.filter(words(c("name")), lambda w: ~w.isin(*CLUB_WORDS)), " ")
    long_words = F.filter(words(c("name")), lambda w: F.length(w) >= 4)
    each = names.select("entity", F.explode(F.array_distinct(F.concat(F.array(plain(c("name")), plain(F.coalesce("short", F.lit(""))), core), long_words))).alias("alias"))
    if other_names is not None:
        each = each.unionByName(other_names.select("entity", plain(c("alias")).alias("alias")))
    return each.where("alias <> ''").groupBy("alias").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1").select("alias", "entity")


def longest_alias(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """The aliases that a title names, and their entities: spans that don't overlap, accepted longest first, then by place.

    Phrases of up to the longest alias's words are met with the aliases by an equi-join; an entity named
    twice by one alias is one row. Of entities that share an alias the smallest is taken.
    """
    words = lambda text: F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != "")
    known = aliases.select(F.array_join(words(c("alias")), " ").alias("alias"), "entity").where("alias <> ''").groupBy("alias").agg(F.min("entity").alias("entity"))
    most = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 0
    staged = titles.select("id", words(c("title")).alias("w")).where(F.size("w") > 0)
    spans = F.flatten(F.transform("w", lambda _, i: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), F.size("w") - i))), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("w", i + 1, n), " ").alias("alias")))))
    hits = staged.select("id", F.explode(spans).alias("s")).select("id", "s.*").join(known, "alias")
    hit = F.struct((-F.length("alias")).alias("size"), "start", "end", "alias", "entity")
    found = hits.groupBy("id").agg(F.sort_array(F.collect_set(hit)).alias("hits"))
    accept = lambda taken, h: F.when(F.exists(taken, lambda t: (h["start"] < t["end"]) & (t["start"] < h["end"])), taken).otherwise(F.array_append(taken, h))
    accepted = F.aggregate("hits", F.filter("hits", lambda _: F.lit(False)), accept)
    return found.select("id", F.explode(accepted).alias("h")).select("id", "h.alias", "h.entity").distinct()


def classify(title: Column) -> Column:
    """Kind of a video by its title; the first rule that fits."""
    rules = [("press", "press conference|pressekonferenz"), ("highlights", "highlights|zusammenfassung"), ("goals", "goals?|tore?"), ("recap", "recap|spielbericht"), ("interview", "interview|reacts|mixed zone"), ("preview", "preview|vorschau"), ("analysis", "analysis|tactical|breakdown|explained")]
    out = F.when(F.lower(title).rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(F.lower(title).rlike(pattern), name)
    return out.otherwise("other")


def cost_report(calls: DataFrame, usd_in: float = 2.5, usd_out: float = 10.0) -> DataFrame:
    """Calls, tokens and cost: in total and by each of five dimensions."""
    by = ("trigger", "lane", "pool", "model", "story")
    cost = (c("tokens_in") * usd_in + c("tokens_out") * usd_out) / 1e6
    sums = calls.withColumn("usd", cost).groupingSets([[], *[[c(x)] for x in by]], *by)
    return sums.agg(F.count("*").alias("calls"), F.sum(c("tokens_in") + c("tokens_out")).cast("long").alias("tokens"), (F.floor(F.sum("usd") * 1e6 + 0.5) / 1e6).alias("usd")).select(*by, "calls", "tokens", "usd")


#: What each angle of a result weighs; from PUBLISH on it is worth a story.
ANGLES = {
    "leader_change": 1.2,
    "title_race_swing": 1.0,
    "top4_entry_exit": 0.8,
    "relegation_zone_move": 0.8,
    "upset": 1.0,
    "comeback_from_ht": 1.0,
    "multi_goal_scorer": 0.6,
    "winning_streak": 1.0,
    "unbeaten_run_ended": 1.0,
    "high_scoring": 0.6,
    "heavy_margin": 0.6,
}
PUBLISH = 1.0


def tables_before(rows: DataFrame) -> DataFrame:
    """The table of each season before each of its days: competition_id, season, day, before (its lines in order, of teams that have played).

    Teams and days of a season are met once and totals carried forward, so there are as many rows
    as days times teams, however many matches a day has.
    """
    key = ["competition_id", "season"]
    by_day = rows.groupBy(*key, "team_id", "day").agg(F.sum("points").alias("p"), F.sum(c("gf") - c("ga")).alias("d"), F.sum("gf").alias("g"), F.count("*").alias("n"))
    grid = by_day.select(*key, "day").distinct().join(by_day.select(*key, "team_id").distinct(), key)
    earlier = Window.partitionBy(*key, "team_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    held = grid.join(by_day, [*key, "team_id", "day"], "left").select(*key, "day", "team_id", *[F.sum(x).over(earlier).alias(x) for x in "pdgn"])
    line = F.struct((-c("p")).alias("p"), (-c("d")).alias("d"), (-c("g")).alias("g"), c("team_id").cast("long").alias("team"), "n")
    return held.groupBy(*key, "day").agg(F.array_sort(F.collect_list(F.when(c("n") > 0, line))).alias("before"))


def match_angles(finished: DataFrame, rows: DataFrame, scorers: DataFrame) -> DataFrame:
    """Angles of every finished match with what each weighs.

    finished: matches with home_score_ht and away_score_ht (may be null); rows: their team rows; scorers:
    (match_id, player_id, goals). A season's table before each of its days is one row, which its matches
    meet by equality of the day; the table after a match is that row with the match's two teams changed.
    """
    key = ["competition_id", "season"]
    games = finished.select(*key, "match_id", "day", "home_team_id", "away_team_id", "home_score", "away_score", "home_score_ht", "away_score_ht")
    known = games.join(tables_before(rows), [*key, "day"])
    # A place in the table: what counts, the larger the sooner, then the team.
    line = lambda p, d, g, team, n: F.struct((-p).alias("p"), (-d).alias("d"), (-g).alias("g"), team.cast("long").alias("team"), n.cast("long").alias("n"))
    zero = F.lit(0).cast("long")
    newcomer = lambda team: F.when(F.exists("before", lambda x: x["team"] == team), F.array()).otherwise(F.array(line(zero, zero, zero, team, zero)))
    home, away = (lambda x: x["team"] == c("home_team_id")), (lambda x: x["team"] == c("away_team_id"))
    margin = c("home_score") - c("away_score")
    won = lambda m: F.when(m > 0, 3).when(m == 0, 1).otherwise(0)
    plus = lambda x, m, g: line(-x["p"] + won(m), -x["d"] + m, -x["g"] + g, x["team"], x["n"])
    both = F.concat("before", newcomer(c("home_team_id")), newcomer(c("away_team_id")))
    played = F.transform(both, lambda x: F.when(home(x), plus(x, margin, c("home_score"))).when(away(x), plus(x, -margin, c("away_score"))).otherwise(x))
    placed = known.withColumn("after", F.array_sort(played))
    at = lambda t, k, x: F.get(F.transform(t, lambda e: e[x]), F.lit(k - 1))
    place = lambda t, team: F.nullif(F.array_position(F.transform(t, lambda e: e["team"]), c(team).cast("long")), zero)
    matches_of = lambda team: F.coalesce(F.get(F.transform(F.filter("before", lambda e: e["team"] == c(team)), lambda e: e["n"]), F.lit(0)), zero)
    tables = placed.select(
        "match_id", F.size("after").alias("teams"),
        *[at(t, k, "team").alias(f"team{k}_{t[0]}") for t in ("before", "after") for k in (1, 2)], *[(-at(t, k, "p")).alias(f"points{k}_{t[0]}") for t in ("before", "after") for k in (1, 2)],
        *[place(t, f"{s}_team_id").alias(f"{s}_{t[0]}") for s in ("home", "away") for t in ("before", "after")], *[matches_of(f"{s}_team_id").alias(f"{s}_n") for s in ("home", "away")],
    )
    ever = Window.partitionBy(*key, "team_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key, "team_id").orderBy("day", "match_id")))
    run = lambda broken: F.count("*").over(ever) - F.coalesce(F.max(F.when(broken, c("k"))).over(ever), F.lit(0))
    runs = numbered.select("match_id", "team_id", run(c("points") < 3).alias("wins"), run(c("points") == 0).alias("unbeaten"))
    winner = F.when(c("home_score") > c("away_score"), c("home_team_id")).when(c("home_score") < c("away_score"), c("away_team_id"))
    loser = F.when(c("home_score") > c("away_score"), c("away_team_id")).when(c("home_score") < c("away_score"), c("home_team_id"))
    many = scorers.where("goals >= 2").groupBy("match_id").agg(F.array_sort(F.collect_list("goals")).alias("many"))
    m = games.select("*", winner.alias("winner"), loser.alias("loser")).join(tables, "match_id").join(many, "match_id", "left")
    m = m.join(runs.select("match_id", c("team_id").alias("winner"), "wins"), ["match_id", "winner"], "left").join(runs.select("match_id", c("team_id").alias("loser"), "unbeaten"), ["match_id", "loser"], "left")
    md = F.greatest("home_n", "away_n") + 1
    either = lambda t: (c(t) == c("home_team_id")) | (c(t) == c("away_team_id"))
    within = lambda x, low, high: (c(x) >= low) & (c(x) <= high)
    moved = lambda s, low, high: c(f"{s}_b").isNotNull() & (md >= 5) & (within(f"{s}_b", low, high) != within(f"{s}_a", low, high))
    win_b, lose_b = (F.when(c("winner") == c("home_team_id"), c(f"{x}_b")).when(c("winner") == c("away_team_id"), c(f"{y}_b")) for x, y in (("home", "away"), ("away", "home")))
    half = F.when(c("winner") == c("home_team_id"), c("home_score_ht") - c("away_score_ht")).when(c("winner") == c("away_team_id"), c("away_score_ht") - c("home_score_ht"))
    low4 = c("teams") - 2
    rules = [
        ("leader_change", c("team1_b").isNotNull() & (c("team1_b") != c("team1_a")) & either("team1_a") & (md >= 3)),
        ("title_race_swing", (md >= 10) & c("team2_b").isNotNull() & (either("team1_b") | either("team2_b") | either("team1_a") | either("team2_a")) & (F.abs((c("points1_a") - c("points2_a")) - (c("points1_b") - c("points2_b"))) >= 3)),
        *[("top4_entry_exit", moved(s, 1, 4)) for s in ("home", "away")],
        *[("relegation_zone_move", moved(s, low4, c("teams"))) for s in ("home", "away")],
        ("upset", (md > 5) & (win_b - lose_b >= 8)),
        ("comeback_from_ht", half < 0),
        ("winning_streak", c("wins") + 1 >= 5),
        ("unbeaten_run_ended", c("unbeaten") >= 8),
        ("high_scoring", c("home_score") + c("away_score") >= 6),
        ("heavy_margin", F.abs(c("home_score") - c("away_score")) >= 4),
    ]
    angle = lambda name, weight: F.struct(F.lit(name).alias("angle"), weight.alias("weight"))
    plain = F.filter(F.array(*[F.when(rule, angle(name, F.lit(ANGLES[name]))) for name, rule in rules]), lambda x: x.isNotNull())
    scoring = F.transform(F.coalesce("many", F.array().cast("array<bigint>")), lambda n: angle("multi_goal_scorer", F.when(n >= 3, 1.2).otherwise(ANGLES["multi_goal_scorer"])))
    return m.select("match_id", F.concat(plain, scoring).alias("angles"))


def materiality(finished: DataFrame, rows: DataFrame, scorers: DataFrame) -> DataFrame:
    """The angles of every finished match (``match_angles``), their sum, and whether it is worth a story."""
    found = match_angles(finished, rows, scorers)
    score = F.floor(F.aggregate("angles", F.lit(0.0), lambda t, x: t + x["weight"]) * 100 + 0.5) / 100
    return found.select("match_id", F.array_join(F.transform("angles", lambda x: x["angle"]), ",").alias("angles"), score.alias("score"), (score >= PUBLISH).alias("material"))


def stories(runs: DataFrame, forms: DataFrame, least_run: int = 3) -> DataFrame:
    """Angles of each team with their weights, and whether their sum is worth a story."""
    angles = F.filter(
        F.array(
            F.when(c("winning") >= least_run, F.struct(F.lit("winning run").alias("angle"), F.lit(1.0).alias("weight"))),
            F.when(c("losing") >= least_run, F.struct(F.lit("losing run").alias("angle"), F.lit(0.8).alias("weight"))),
            F.when((c("unbeaten") >= 2 * least_run) & (c("winning") < least_run), F.struct(F.lit("unbeaten run").alias("angle"), F.lit(0.7).alias("weight"))),
            F.when(c("form").rlike("^W.*L$"), F.struct(F.lit("turnaround").alias("angle"), F.lit(0.4).alias("weight"))),
        ),
        lambda x: x.isNotNull(),
    )
    each = runs.join(forms, "team_id").select("team_id", angles.alias("angles"))
    weight = F.floor(F.aggregate("angles", F.lit(0.0), lambda a, x: a + x["weight"]) * 100 + 0.5) / 100
    return each.select("team_id", F.array_join(F.transform("angles", lambda x: x["angle"]), ",").alias("angles"), weight.alias("weight"), (weight >= 1.0).alias("material"))

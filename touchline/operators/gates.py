"""Phrase gates of an article by its kind and its competition's profile, and claims that need a verified group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BANNED

c = F.col

#: Phrases that a preview may not use, beside those of all articles.
PREVIEW = {
    "preview_prediction": r"(?i)\b(will (win|beat|lose|draw|score|claim|take)|(is|are) (expected|likely|set|tipped|poised) to|should (win|beat|edge)|predict\w*|prediction|forecast\w*|favou?rites?|underdogs?|chances? of (winning|victory)|probabilit\w*|projected|must-win|expect(s|ed)? (a|an|the)? ?(win|victory|result))\b",
    "preview_team_news": r"(?i)\b(team news|line-?ups? (is|are) (expected|likely)|predicted (xi|line-?up)|starting (xi|line-?up) (will|is expected)|(fitness|selection|injury) doubts?|available again|(miss|misses|missing) (the|this) (match|game|fixture))\b",
}
#: Phrases that a competition's format makes false, by profile.
EUROPEAN_PLACES = {"european_places_claim": r"(?i)\b((champions|europa|conference) league (places?|spots?|qualification|football)|european (places?|spots?|qualification|football)|qualif\w* for (europe|the champions league|the europa league))\b"}
NATIONAL = {
    "nl_domestic_race_language": r"(?i)\b(title race|title rivals?|top[ -]four|relegation zone|drop zone|bottom three|survival (fight|battle|race)|top of the (table|league)|league table|league leaders?)\b",
    "nl_club_language": r"(?i)\bclubs?\b",
}
AGGREGATE = {"knockout_aggregate": r"(?i)\b(aggregate|through to|eliminated|knocked out|progress(es|ed)? to)\b"}
TOP_FOUR = {"ucl_top_four": r"(?i)\btop[ -]four\b"}
PROFILES: dict[str, dict[str, str]] = {
    "domestic_european_league": EUROPEAN_PLACES,
    "domestic_league_relegation_playoff": {**EUROPEAN_PLACES, "relegation_claim_unsupported": r"(?i)\b(relegat\w*|drop zone|go(es|ing)? down)\b"},
    "mls": {
        "mls_relegation": r"(?i)\b(relegat\w*|drop zone|bottom three|survival|go down)\b",
        "mls_european_places": r"(?i)\b(europe\w*|champions league|europa|top[ -]four|continental places?)\b",
        "mls_conference_claim": r"(?i)\b(eastern|western) conference\b",
        "mls_playoff_claim": r"(?i)\bplayoff (spot|place|line|position)s?\b",
    },
    "ucl_league_phase": {
        **TOP_FOUR,
        "ucl_table_claim": r"(?i)\b(league[ -]phase table|standings|top of the (table|league)|table|relegat\w*|title race)\b",
        "ucl_qualification_claim": r"(?i)\b(qualif\w*|round of 16|knockout play-?off|eliminated|through to)\b",
    },
    "knockout": {**AGGREGATE, **TOP_FOUR},
    "nations_league": NATIONAL,
    "nations_league_knockout": {**AGGREGATE, **NATIONAL},
}
#: Rules that a verified group lifts.
LIFTED = ("mls_conference_claim", "ucl_table_claim", "ucl_qualification_claim")
#: Claims that need a verified group, and a zone note of it that says the same where a second pattern stands.
CLAIMS: dict[str, dict[str, tuple[str, str | None]]] = {
    "nations_league": {
        "nl_group_position_claim": (r"(?i)\b(group (lead(ers?)?|winners?|standings|table)|top of (the |their )?group|(lead|leads|leading|led) (the |their )?group|bottom of (the |their )?group|standings)\b", None),
        "nl_quarterfinal_claim": (r"(?i)\bquarter-?finals?\b|\bqfs?\b", r"(?i)\b(quarter|qfs?)\b"),
        "nl_promotion_claim": (r"(?i)\bpromot\w*", r"(?i)promot"),
        "nl_relegation_claim": (r"(?i)\brelegat\w*", r"(?i)relegat"),
        "nl_playoff_claim": (r"(?i)\bplay-?offs?\b", r"(?i)play-?offs?"),
    }
}


def _noted(zones: Column, support: str) -> Column:
    return F.exists(F.coalesce(zones, F.array().cast("array<string>")), lambda z: z.rlike(support))


def failed(text: Column, kind: Column, profile: Column, verified: Column, zones: Column, possession: Column) -> Column:
    """Names of the rules that a text breaks, in order: those of all articles, of its profile, of previews, and unsupported claims.

    ``verified``: the packet has a verified group, whose zone notes are ``zones``; ``possession``: it has both
    sides' figure, so the word may be used. An unknown profile adds no rule.
    """
    known = F.coalesce(verified, F.lit(False))
    rules: list[tuple[str, Column]] = []
    for name, pattern in BANNED.items():
        hit = text.rlike(pattern)
        rules.append((name, hit & ~F.coalesce(possession, F.lit(False)) if name == "unsupported_possession" else hit))
    for of, banned in PROFILES.items():
        for name, pattern in banned.items():
            hit = profile.eqNullSafe(of) & text.rlike(pattern)
            rules.append((name, hit & ~known if name in LIFTED else hit))
    rules += [(name, kind.eqNullSafe("match_preview") & text.rlike(pattern)) for name, pattern in PREVIEW.items()]
    for of, claims in CLAIMS.items():
        for name, (pattern, support) in claims.items():
            backed = known if support is None else known & _noted(zones, support)
            rules.append((name, profile.eqNullSafe(of) & text.rlike(pattern) & ~F.coalesce(backed, F.lit(False))))
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules]), lambda x: x.isNotNull())


def gated(articles: DataFrame) -> DataFrame:
    """id, failed (rules, joined), passes: articles of id, text, kind, profile, verified, zones, possession; a null text breaks no rule."""
    broken = failed(c("text"), c("kind"), c("profile"), c("verified"), c("zones"), c("possession"))
    return articles.select("id", F.array_join(broken, ",").alias("failed"), (F.size(broken) == 0).alias("passes"))


def profile_of(competition: Column, kickoff: Column, league_phase_end: Column) -> Column:
    """The profile of a competition on a day: two of them turn into knockouts when their league phase ends; no end known, no profile."""
    before = kickoff < league_phase_end
    phased = lambda league, knockout: F.when(before, league).when(~before, knockout)
    return (
        F.when(competition == "premier-league", "domestic_european_league")
        .when(competition == "bundesliga", "domestic_league_relegation_playoff")
        .when(competition == "mls", "mls")
        .when(competition == "uefa-champions-league", phased("ucl_league_phase", "knockout"))
        .when(competition == "uefa-nations-league", phased("nations_league", "nations_league_knockout"))
    )

"""Column rules: mappings of codes, states, names, licences and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import fold


#: Event codes of the ledger files, as (type, subtype) or (type, subtype, set piece).
SUB_EVENTS = {
    10: ("duel", "aerial"), 11: ("duel", "ground_attacking"), 12: ("duel", "ground_defending"), 13: ("duel", "ground_loose_ball"),
    20: ("foul", "foul"), 21: ("foul", "hand_ball"), 22: ("foul", "late_card"), 23: ("foul", "out_of_game"), 24: ("foul", "protest"), 25: ("foul", "simulation"), 26: ("foul", "time_lost"), 27: ("foul", "violent"),
    30: ("pass", "corner", "corner"), 31: ("pass", "free_kick", "free_kick"), 32: ("pass", "cross", "free_kick"), 33: ("shot", "free_kick", "free_kick"), 34: ("pass", "goal_kick", "goal_kick"), 35: ("shot", "penalty", "penalty"), 36: ("pass", "throw_in", "throw_in"),
    50: ("interruption", "ball_out"), 51: ("interruption", "whistle"), 70: ("acceleration", "acceleration"), 71: ("clearance", "clearance"), 72: ("touch", "touch"),
    80: ("pass", "cross"), 81: ("pass", "hand_pass"), 82: ("pass", "head_pass"), 83: ("pass", "high_pass"), 84: ("pass", "launch"), 85: ("pass", "simple"), 86: ("pass", "smart"),
    90: ("save", "reflexes"), 91: ("save", "save_attempt"), 100: ("shot", "open_play"),
}
EVENTS = {4: ("keeper_exit", "keeper_exit"), 6: ("offside", "offside")}
#: Tags of the ledger files.
TAGS = {"goal": 101, "accurate": 1801, "not_accurate": 1802, "blocked": 2101, "lost": 701, "neutral": 702, "won": 703}


def _coded(table: dict[int, tuple], code: Column) -> Column:
    kinds = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("type", "subtype", "set_piece"), (*kind, None)[:3])]) for kind in table.values()]
    return F.try_element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*kinds)), code.cast("int"))


def event_kind(event: Column, sub: Column) -> Column:
    """type, subtype and set_piece of an event: by its sub-event, else by its event; null for codes that aren't known, which are never guessed."""
    return F.coalesce(_coded(SUB_EVENTS, sub), _coded(EVENTS, event))


def outcome(kind: Column, tags: Column) -> Column:
    """What became of an event of a type, by its tags; null where they don't say."""
    has = lambda name: F.coalesce(F.array_contains(tags, TAGS[name]), F.lit(False))
    shot = kind == "shot"
    duel = F.when(has("won"), "won").when(has("lost"), "lost").when(has("neutral"), "neutral")
    missed = F.when(shot, F.when(has("blocked"), "blocked").otherwise("off_target")).otherwise("fail")
    return F.when(shot & has("goal"), "goal").when(kind == "duel", duel).when(has("accurate"), F.when(shot, "on_target").otherwise("success")).when(has("not_accurate"), missed)


#: A match without a final word counts as live for so long after its kickoff.
LIVE_FOR = "3 hours"


def match_state(status: Column, kickoff: Column, now: Column) -> Column:
    """finished and postponed as told; others by the clock: scheduled before the kickoff, live for LIVE_FOR from it on, then unknown."""
    return F.when(status.isin("finished", "postponed"), status).when(kickoff > now, "scheduled").when(kickoff > now - F.expr(f"interval {LIVE_FOR}"), "live").otherwise("unknown")


def stage_role(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("play-?off|final|relegation"), "playoff").when(low.rlike("friendly|test"), "excluded").otherwise("league")


def stage_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def beneficiary(is_own_goal: Column, tagged: Column, home: Column, away: Column, family: Column) -> Column:
    """Which team a goal counts for: one family tags the scorer's own team, the others the team that gains."""
    other = F.when(tagged == home, away).otherwise(home)
    return F.when(is_own_goal & (family == "wyscout_figshare"), other).otherwise(tagged)


def names_match(name: Column, needle: str) -> Column:
    """Whether a folded name contains a folded needle of two letters or more."""
    return F.contains(fold(name), fold(F.lit(needle))) if len(needle) >= 2 else F.lit(False)


def phrase_in(title: Column, alias: Column) -> Column:
    """Whether an alias stands in a title between word boundaries."""
    plain = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.contains(plain(title), plain(alias))


def zone_note(note: Column, letter: Column) -> Column:
    """The part of "A: ...; B-D: ..." that names a letter, ranges too."""
    parts = F.split(note, r";\s*")
    first, last = (lambda p: F.ascii(F.substring(p, 1, 1))), (lambda p: F.when(F.substring(p, 2, 1) == "-", F.ascii(F.substring(p, 3, 1))).otherwise(F.ascii(F.substring(p, 1, 1))))
    hit = F.filter(parts, lambda p: (F.ascii(letter) >= first(p)) & (F.ascii(letter) <= last(p)))
    return F.regexp_replace(F.get(hit, F.lit(0)), r"^[A-Z](?:-[A-Z])?:\s*", "")


#: Number words of prose.
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def number_words(text: Column) -> Column:
    """Numbers that a text writes as words, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*NUMBER_WORDS))
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.transform(words, lambda w: F.element_at(table, w))


def licence(name: Column, code: Column, url: Column, author: Column, non_free: Column, crest: Column) -> Column:
    """Whether a picture may be used, by its file's licence name and code; what isn't clearly free isn't approved.

    Non-free files are rejected, and those not for trade or changes are restricted, whatever else they
    say. A licence that asks for credit needs an author and an address. A crest is approved only
    where the file itself is in the public domain.
    """
    name, code = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(code, F.lit(""))))
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    public = code.rlike("^(cc0|pd)") | name.rlike("public domain|^cc0")
    credited = code.rlike(r"^cc-by(-sa)?-\d") | name.rlike(r"^cc by(-sa)? \d")
    owned = crest & ~code.rlike("^pd") & ~name.rlike("public domain")
    review = (credited & ~(said(author) & said(url))) | owned
    free = F.when(review, "review_required").otherwise("approved")
    return F.when(F.coalesce(non_free, F.lit(False)), "rejected").when(code.rlike("-nc|-nd") | name.rlike(r"\b(nc|nd)\b"), "restricted").when(public | credited, free).otherwise("review_required")

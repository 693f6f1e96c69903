"""Play-by-play captures: typed events in order, with the unit of a match's coordinates inferred from the match itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_up, to_pitch

c = F.col

_REF = "struct<`$ref`:string>"
PLAY = (
    "struct<id:string,valid:boolean,type:struct<text:string>,period:struct<number:int>,clock:struct<value:double>,team:" + _REF + ",participants:array<struct<order:int,athlete:" + _REF + ">>,"
    "fieldPositionX:double,fieldPositionY:double,fieldPosition2X:double,fieldPosition2Y:double,ownGoal:boolean,scoringPlay:boolean,yellowCard:boolean,redCard:boolean,contactType:struct<text:string>>"
)

#: Play types by their text, as type, subtype, outcome, set piece, card.
PLAYS: dict[str, tuple] = {
    "Pass": ("pass", "simple"), "Cross": ("pass", "cross"), "Blocked Pass": ("pass", "blocked", "fail"),
    "Throw In": ("pass", "throw_in", None, "throw_in"), "Goal Kick": ("pass", "goal_kick", None, "goal_kick"), "Kickoff": ("pass", "kick_off", None, "kick_off"),
    "Shot On Target": ("shot", "open_play", "on_target"), "Shot Off Target": ("shot", "open_play", "off_target"), "Shot Blocked": ("shot", "open_play", "blocked"),
    "Goal": ("shot", "open_play", "goal"), "Goal - Header": ("shot", "open_play", "goal"), "Goal - Free-kick": ("shot", "free_kick", "goal", "free_kick"), "Goal - Volley": ("shot", "open_play", "goal"),
    "Penalty - Scored": ("shot", "penalty", "goal", "penalty"), "Penalty - Saved": ("shot", "penalty", "on_target", "penalty"), "Penalty - Missed": ("shot", "penalty", "off_target", "penalty"),
    "Save": ("save", "save"), "Punch": ("save", "punch"), "Claim": ("keeper_exit", "claim"), "Keeper Sweeper": ("keeper_exit", "sweeper"),
    "Aerial": ("duel", "aerial"), "Take On": ("duel", "take_on"), "Dispossessed": ("duel", "dispossessed", "lost"),
    "Tackle": ("tackle", "tackle", "success"), "Attempted tackle": ("tackle", "tackle", "fail"), "Interception": ("interception", "interception"),
    "Clear": ("clearance", "clearance"), "Ball touch": ("touch", "touch"), "Foul": ("foul", "foul"), "Offside": ("offside", "offside"),
    "Yellow Card": ("card", "yellow", None, None, "yellow"), "Red Card": ("card", "red", None, None, "red"), "Substitution": ("substitution", "substitution"),
    "Out": ("interruption", "ball_out"), "Drop of Ball": ("interruption", "drop_ball"), "Corner Awarded": ("interruption", "corner_awarded"),
}
#: Texts that aren't listed but tell their kind.
GOAL_TEXT = r"^Goal( - |$)"
INTERRUPTION_TEXT = r"^(Start|End) |Delay|VAR|Deleted After Review|Half|Regular Time|Extra Time"
BODY = {"Left Foot": "left_foot", "Right Foot": "right_foot", "Head": "head"}
PERIODS = {1: "1H", 2: "2H", 3: "E1", 4: "E2", 5: "PS"}
PERIOD_STARTS = {1: 0, 2: 2700, 3: 5400, 4: 6300, 5: 7200}
FIELDS = ("type", "subtype", "outcome", "set_piece", "card")
#: Located plays that a match needs for its unit to be told.
LEAST_LOCATED = 5


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def kind_of(text: Column) -> Column:
    """type, subtype, outcome, set_piece and card of a play's text; others are 'unmapped' with their text as subtype, never guessed."""
    full = lambda *values: F.struct(*[F.lit(v).cast("string").alias(n) if not isinstance(v, Column) else v.alias(n) for n, v in zip(FIELDS, (*values, *[None] * 5)[:5])])
    listed = F.try_element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in PLAYS]), F.array(*[full(*v) for v in PLAYS.values()])), text)
    slug = F.concat(F.lit("espn_"), F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", ""))
    return F.when(listed.isNotNull(), listed).when(text.rlike(GOAL_TEXT), full("shot", "open_play", "goal")).when(text.rlike(INTERRUPTION_TEXT), full("interruption", slug)).otherwise(full("unmapped", slug))


def located(play: Column) -> Column:
    x, y = play["fieldPositionX"], play["fieldPositionY"]
    return x.isNotNull() & y.isNotNull() & ((x != 0) | (y != 0))


def coordinate_unit(plays: Column) -> Column:
    """'unit' where every located play of a match lies within 1, and there are enough of them; 'percent' for others, 'none' without any.

    The 0 to 1 scale is of another frame, whose direction isn't known, so it is never mapped.
    """
    places = F.filter(plays, located)
    small = F.forall(places, lambda p: (F.abs(p["fieldPositionX"]) <= 1) & (F.abs(p["fieldPositionY"]) <= 1))
    return F.when((F.size(places) >= LEAST_LOCATED) & small, "unit").when(F.size(places) > 0, "percent").otherwise("none")


def ref_id(ref: Column) -> Column:
    """The number at the end of a reference's path."""
    return F.nullif(F.regexp_extract(ref, r"/(\d+)(?:\?|$)", 1), F.lit(""))


def play_rows(raw: DataFrame, body: str = "body") -> DataFrame:
    """Captures (match_id, body: JSON with ``items``) as events in order of period, clock and number; broken captures give none, withdrawn plays neither.

    A match is one row until its plays are numbered, so its unit, order and events need no shuffle.
    """
    items = F.from_json(c(body), f"struct<items:array<{PLAY}>>")["items"]
    kept = raw.select("match_id", F.filter(items, lambda p: p["id"].isNotNull() & ~(p["valid"].eqNullSafe(False))).alias("plays"))
    order = lambda p: F.struct(F.coalesce(p["period"]["number"], F.lit(0)).alias("period"), F.coalesce(p["clock"]["value"], F.lit(0.0)).alias("clock"), p["id"].cast("long").alias("number"), p.alias("p"))
    sortable = kept.select("match_id", coordinate_unit(c("plays")).alias("unit"), F.transform("plays", order).alias("plays"))
    # By the three numbers alone: plays hold maps of no order of their own.
    by = lambda a, b: F.when(a["period"] != b["period"], a["period"] - b["period"]).when(a["clock"] != b["clock"], F.when(a["clock"] < b["clock"], -1).otherwise(1)).when(a["number"] < b["number"], -1).when(a["number"] > b["number"], 1).otherwise(0)
    each = sortable.select("match_id", "unit", F.posexplode(F.array_sort("plays", by)).alias("at", "s")).select("match_id", "unit", (c("at") + 1).alias("sequence"), "s.p")
    text = F.coalesce(c("p.type.text"), F.lit(""))
    own = F.coalesce(c("p.ownGoal"), F.lit(False))
    each = each.select("*", kind_of(text).alias("kind"), own.alias("own"))
    number = c("p.period.number")
    clock = c("p.clock.value")
    actor = F.coalesce(F.get(F.filter("p.participants", lambda a: a["order"] == 1), F.lit(0)), F.get("p.participants", F.lit(0)))
    x, y = to_pitch(c("p.fieldPositionX"), c("p.fieldPositionY"), 100.0, 100.0, flip_y=True)
    ex, ey = to_pitch(c("p.fieldPosition2X"), c("p.fieldPosition2Y"), 100.0, 100.0, flip_y=True)
    percent, passed = c("unit") != "unit", c("kind.type") == "pass"
    has = c("p.fieldPositionX").isNotNull() & c("p.fieldPositionY").isNotNull()
    return each.select(
        "match_id", "sequence", c("p.id").alias("source_event_id"), ref_id(c("p.team.$ref")).alias("team"), ref_id(actor["athlete"]["$ref"]).alias("player"), _looked_up(PERIODS, number).alias("period"),
        F.greatest(clock - _looked_up(PERIOD_STARTS, number), F.lit(0.0)).alias("clock_seconds"), (F.floor(clock / 60) + 1).cast("int").alias("minute"),
        F.when(c("own"), "touch").otherwise(c("kind.type")).alias("event_type"), F.when(c("own"), "own_goal").otherwise(c("kind.subtype")).alias("subtype"), c("kind.set_piece").alias("set_piece"),
        F.when(c("own"), "goal").otherwise(c("kind.outcome")).alias("outcome"), _looked_up(BODY, c("p.contactType.text")).alias("body_part"),
        F.coalesce((c("kind.outcome") == "goal") & ~c("own") & ~c("p.scoringPlay").eqNullSafe(False), F.lit(False)).alias("is_goal"), c("own").alias("is_own_goal"),
        F.coalesce(c("kind.card"), F.when(c("p.redCard"), "red").when(c("p.yellowCard"), "yellow")).alias("card"),
        c("p.fieldPositionX").alias("source_x"), c("p.fieldPositionY").alias("source_y"), F.when(has, c("unit")).otherwise("none").alias("coordinates"),
        *[half_up(F.when(percent & ok, v), 2).alias(n) for n, v, ok in (("x_m", x, F.lit(True)), ("y_m", y, F.lit(True)), ("end_x_m", ex, passed), ("end_y_m", ey, passed))],
    )

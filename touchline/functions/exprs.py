"""Column builders: rounding, geometry, clock, folding, hashes, text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 105.0, 68.0


def half_up(x: Column, digits: int) -> Column:
    """Half up on the binary double, as floor(x * 10**d + 0.5) / 10**d."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; null where b is 0 or missing."""
    return half_up(F.try_divide(a.cast("double"), b.cast("double")), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_pitch(x: Column, y: Column, x_most: float, y_most: float, flip_y: bool = False) -> tuple[Column, Column]:
    """A provider's coordinates on the 105 x 68 pitch; out of range is missing, never clamped."""
    inside = x.between(0, x_most) & y.between(0, y_most)
    up = (y_most - y) if flip_y else y
    return F.when(inside, x / x_most * LENGTH), F.when(inside, up / y_most * WIDTH)


def from_pitch(x: Column, y: Column, x_most: float, y_most: float) -> tuple[Column, Column]:
    return x / LENGTH * x_most, y / WIDTH * y_most


def attacking(x: Column, y: Column, is_home: Column) -> tuple[Column, Column]:
    """The match frame turned by half a circle for the away side."""
    return F.when(is_home, x).otherwise(LENGTH - x), F.when(is_home, y).otherwise(WIDTH - y)


def third(x: Column) -> Column:
    return F.when(x < 35, "defensive").when(x < 70, "middle").when(x.isNotNull(), "final")


def channel(y: Column) -> Column:
    return F.when(y < 22.67, "right").when(y > 45.33, "left").when(y.isNotNull(), "centre")


def in_area(x: Column, y: Column) -> Column:
    return (x >= 88.5) & (F.abs(y - 34.0) <= 20.16)


def goal_distance(x: Column, y: Column) -> Column:
    return half_up(F.hypot(LENGTH - x, 34.0 - y), 1)


def phase(minute: Column) -> Column:
    """Fifteen-minute phases, stoppage in the last of its half."""
    return F.when(minute <= 15, "01-15").when(minute <= 30, "16-30").when(minute <= 45, "31-45").when(minute <= 60, "46-60").when(minute <= 75, "61-75").when(minute.isNotNull(), "76-90")


def football_minute(seconds: Column, period_start: Column) -> Column:
    return (F.floor(seconds / 60) + 1 + period_start).cast("int")


def shown_minute(minute: Column, nominal_end: Column) -> Column:
    """45+2 beyond the period's nominal end."""
    return F.when(minute > nominal_end, F.concat(nominal_end.cast("string"), F.lit("+"), (minute - nominal_end).cast("string"), F.lit("'"))).otherwise(F.concat(minute.cast("string"), F.lit("'")))


def winner(home: Column, away: Column, home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, home).when(away_goals > home_goals, away)


def season_label(first_year: Column, last_year: Column) -> Column:
    return F.when(first_year == last_year, first_year.cast("string")).otherwise(F.concat(first_year.cast("string"), F.lit("/"), F.lpad((last_year % 100).cast("string"), 2, "0")))


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


#: Letters and what folding makes of them.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčćđøłāēīōū"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszccdolaeiou"


def fold(name: Column) -> Column:
    """Lower case without accents; ß and æ as two letters."""
    return F.translate(F.replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), _ACCENTED, _PLAIN)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a text, by SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with fields in name order; missing fields are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def normal_url(url: Column) -> Column:
    """Query parameters in order, fragment dropped."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(F.regexp_replace(bare, r"\?.*$", ""), F.when(params == "", F.lit("")).otherwise(F.concat(F.lit("?"), params)))


def numbers(text: Column) -> Column:
    """Distinct numbers that a text states, in text order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def poisson(k: int, rate: Column) -> Column:
    factorial = 1.0
    for i in range(2, k + 1):
        factorial *= i
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / factorial

"""Format-preserving pseudonyms by a keyed Feistel network.

Validated values in texts are replaced by others of the same format: payment card numbers
(Luhn), telephone numbers, IPv4 addresses, calendar dates of 1900 to 2099, e-mail
addresses, and access keys and tokens. A value is an array of positions, each with a radix
(10 for a digit, 26 for a letter, 256 for an octet); a Feistel network of ROUNDS rounds adds
to one half of the positions, modulo their radix, a keyed hash of the other half. That
permutes the values of a format, so equal values get equal pseudonyms in all documents and
different ones stay different. Separators are no part of a value: the forms of one card, telephone
number or date get the same new digits, and letters of an address the same in either case. Card numbers get a new check digit; dates are permuted as day
numbers, walking the permutation's cycle until the result is a day of the range. A date whose
usual order (MM/DD with slashes, else DD first) is no day is read in the other order; such days
come after the 12th and are permuted among themselves, so they can't be taken for the usual order.

Written forms: telephone numbers with + or 00 and a country code, with a trunk 0, and of three,
three and four digits, with or without brackets (8 to 15 digits; their country code stays);
cards of 13 to 19 digits in a row or grouped 4-4-4-4(-1 to 3), 4-6-5 and 4-6-4; numeric dates,
also before a time; tokens and passwords after their name and = or :, tokens after "bearer".
Names of months, years of two digits and bare numbers without +, 00 or 0 are not taken.

Only DataFrame functions are used, and nothing is shuffled. Defined results: null stays null,
with no values; what looks like a value but fails validation is left as it is, and counted;
values next to each other are told apart by the patterns below, in their order. Long texts are
searched whole; repeated rows and null ids are rows like any other, an empty table stays empty;
columns are taken by position, so their names don't matter.

Whoever knows the key can invert the pseudonyms. It must be given; queries and the pipeline read
the setting ``spark.touchline.pseudonymKey`` of the session and fall back to DEMO_KEY, which is
public, only where that is unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

ROUNDS = 8
KEY_SETTING = "spark.touchline.pseudonymKey"
#: For tests and demonstrations; everyone knows it.
DEMO_KEY = "demonstration key"

#: Country codes but 1 (E.164).
_COUNTRY = r"(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
_NO_MORE = r"(?!\d|[./-]\d)"
_NO_DATE = r"(?! (?:19|20)\d\d-\d\d-)"
_BRACKETS = r"\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
_THREE_THREE_FOUR = rf"(?:\+1[ .-]?\d{{3}}[ .-]?\d{{3}}[ .-]?\d{{4}}|(?<!\d[.,-])(?:1[ .-])?\d{{3}}(?:-\d{{3}}-|\.\d{{3}}\.| \d{{3}}[ -])\d{{4}}){_NO_MORE}"
_ABROAD = rf"(?:\+{_COUNTRY}|00(?:1|{_COUNTRY})(?=[ .-]|\d{{9}}))(?:[ .-]?\(\d{{1,4}}\))?(?:{_NO_DATE}[ ./-]?\d){{6,12}}{_NO_MORE}"
_TRUNK = rf"(?<!\d[.,-])(?:0[1-9](?:(?:[ .-]\d\d){{4}}|\d{{8,9}}|\d{{1,3}}[ /-](?:{_NO_DATE}[ -]?\d){{4,8}})|\(0\d{{1,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}){_NO_MORE}"
#: Not where the next pair of a list or a mark-up tag begins.
_GOES_ON = r"(?![,;&]\w{1,20}[=:]|</?[A-Za-z]{1,10}\d?[\s/>])"
#: Kinds and their patterns; an earlier one wins where several match.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "phone": rf"(?<![\w+])(?:{_BRACKETS}|{_THREE_THREE_FOUR}|{_ABROAD}|{_TRUNK})(?!\d)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "date": r"(?<![\w.-])(?:(?:19|20)\d\d(?:-\d\d-|/\d\d/)\d\d|\d\d?(?:\.\d\d?\.|/\d\d?/|-\d\d?-)(?:19|20)\d\d)(?:(?=[Tt]\d\d:?\d\d)|(?![\w-]|\.\d))",
    "card": r"(?<![\w])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\w)",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?:(?i:token|secret|(?:api|access|private)[_ -]?key)(?:[_-]\w{1,20})?[\"']?\s*[=:]\s*[\"']?|(?i:bearer)\s+)[A-Za-z0-9_.~+/=-]{16,}+[\"']?",
    "password": rf"(?i:password|passwd|pwd)[\"']?\s*[=:]\s*(?:\"[^\"\n]{{6,}}+\"|'[^'\n]{{6,}}+'|[\"']?(?:{_GOES_ON}[^\s\"']){{6,}}+[\"']?)",
}
_ANY = "|".join(PATTERNS.values())
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef"
#: Symbols of passwords; others stay.
_SYMBOLS = "!#$%&*+?@^~"
_FIRST_DAY = "1900-01-01"
#: Days from 1900-01-01 to 2099-12-31, and the radices of the network that holds them.
_DAYS, _DAY_RADICES = 73049, (271, 270)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, radices: Column, key: str, tag: Column) -> Column:
    """Permute arrays of positions (int, below their radix); ``tag`` names the format."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def turn(x: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(x, half + 1, n - half)).otherwise(F.slice(x, F.lit(1), half))
        said = F.array_join(other.cast("array<string>"), ",")

        def step(v: Column, i: Column, said: Column) -> Column:
            hashed = F.sha2(F.concat_ws("|", F.lit(key), tag, r, i, said), 256)
            number = F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long")
            return F.when(left == (i < half), F.pmod(v + number, F.get(radices, i)).cast("int")).otherwise(v)

        return let(said, lambda once: F.transform(x, lambda v, i: step(v, i, once)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _alphabet(c: Column, hexadecimal: Column | None = None, first: Column | None = None, leads: tuple[str, ...] = (), symbols: str = "") -> Column:
    """Letters that may stand for a character; none for one that stays."""
    digit = F.lit(_DIGITS)
    if first is not None:
        lead = F.lit(leads[-1])
        for group in leads[:-1]:
            lead = F.when(F.instr(F.lit(group), c) > 0, F.lit(group)).otherwise(lead)
        digit = F.when(first, lead).otherwise(digit)
    lower = F.lit(_LOWER) if hexadecimal is None else F.when(hexadecimal, F.lit(_HEX)).otherwise(F.lit(_LOWER))
    out = F.when(c.rlike("^[0-9]$"), digit).when(c.rlike("^[a-z]$"), lower).when(c.rlike("^[A-Z]$"), F.lit(_UPPER))
    if symbols:
        out = out.when(F.instr(F.lit(symbols), c) > 0, F.lit(symbols))
    return out.otherwise(F.lit(""))


def _permuted(body: Column, key: str, kind: str, hexadecimal: Column | None = None, first: list[int] | None = None, leads: tuple[str, ...] = ("01", "23456789"), symbols: str = "") -> Column:
    """The characters of ``body`` permuted within their alphabets; digits at the ``first`` places within their one of ``leads``."""
    place = (lambda i: F.array_contains(F.array(*[F.lit(k) for k in first]), i)) if first else (lambda i: None)

    def chosen(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.struct(c.alias("c"), _alphabet(c, hexadecimal, place(i), leads, symbols).alias("a")))

    def moved(z: Column) -> Column:
        radices = F.transform(z, lambda x: F.greatest(F.length(x["a"]), F.lit(1)))
        values = F.transform(z, lambda x: F.greatest(F.instr(x["a"], x["c"]) - 1, F.lit(0)).cast("int"))
        return let(radices, lambda r: feistel(values, r, key, F.concat_ws(":", F.lit(kind), F.array_join(r.cast("array<string>"), ","))))

    def shown(z: Column) -> Column:
        return F.array_join(F.zip_with(z, moved(z), lambda x, v: F.when(x["a"] == "", x["c"]).otherwise(F.substr(x["a"], v + 1, F.lit(1)))), "")

    return let(chosen(F.filter(F.split(body, ""), lambda c: c != "")), shown)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum of a digit string; every second digit from the right is doubled, from the given place (0: the last)."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(places, lambda c, i: F.when(i % 2 == doubled_from_right, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def _card(m: Column, key: str) -> Column:
    def moved(m: Column) -> Column:
        digits = F.translate(m, " -", "")
        n = F.length(digits)
        middle = _permuted(F.substr(digits, F.lit(2), n - 2), key, "card")
        payload = F.concat(F.substr(digits, F.lit(1), F.lit(1)), middle)
        whole = F.concat(payload, ((10 - luhn_sum(payload, 0) % 10) % 10).cast("string"))
        place = lambda i: F.length(F.translate(F.substr(m, F.lit(1), i + 1), " -", ""))
        grouped = let(whole, lambda w: F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c, i: F.when(c.isin(" ", "-"), c).otherwise(F.substr(w, place(i), F.lit(1)))), ""))
        return F.when(luhn_sum(digits, 1) % 10 == 0, F.when(F.length(m) > n, grouped).otherwise(whole))

    # Digits after four groups of four belong to the card, or else are another number, as the security code.
    four = F.substr(m, F.lit(1), F.lit(19))
    more = (F.length(m) > 19) & m.rlike(r"^\d{4}[ -]\d{4}[ -]")
    return F.coalesce(moved(m), F.when(more, F.concat(moved(four), F.substr(m, F.lit(20), F.length(m)))))


def permuted_day(day: Column, key: str, late: bool = False) -> Column:
    """A day number of the range to another: the network again and again until it is in the range.

    ``late``: days after the 12th of their month, permuted among themselves; null if the walk
    is longer than the tries (each ends it with a chance of more than a half).
    """
    a, b = _DAY_RADICES

    def once(n: Column) -> Column:
        x = feistel(F.array(F.floor(n / b).cast("int"), (n % b).cast("int")), F.array(F.lit(a), F.lit(b)), key, F.lit("date"))
        return F.get(x, F.lit(0)) * b + F.get(x, F.lit(1))

    def fits(n: Column) -> Column:
        within = n < _DAYS
        return within & (F.dayofmonth(F.date_add(F.lit(_FIRST_DAY).cast("date"), n)) > 12) if late else within

    # No walk can be longer than the numbers outside the range, plus one.
    tries = F.sequence(F.lit(0), F.lit(a * b - _DAYS))
    start = F.struct(day.cast("int").alias("n"), F.lit(False).alias("done"))
    step = lambda s: let(once(s["n"]).cast("int"), lambda n: F.struct(n.alias("n"), fits(n).alias("done")))
    end = F.aggregate(tries, start, lambda s, _: F.when(s["done"], s).otherwise(step(s)))
    return let(end, lambda s: F.when(s["done"], s["n"])) if late else end["n"]


def _date(m: Column, key: str) -> Column:
    part = lambda k: F.get(F.split(m, "[./-]"), F.lit(k))
    two = lambda x: F.lpad(x, 2, "0")
    day = lambda y, mo, d: F.datediff(F.try_to_date(F.concat_ws("-", y, two(mo), two(d)), "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))
    year_first, slash = m.rlike(r"^\d{4}"), m.contains("/")
    day_first, month_first = day(part(2), part(1), part(0)), day(part(2), part(0), part(1))
    usual = F.when(year_first, day(part(0), part(1), part(2))).when(slash, month_first).otherwise(day_first)
    other = F.when(year_first, F.lit(None)).when(slash, day_first).otherwise(month_first)
    sep = F.regexp_extract(m, "[./-]", 0)
    padded = year_first | m.rlike(r"^\d\d\D\d\d\D")

    def shown(n: Column, swapped: bool) -> Column:
        moved = F.date_add(F.lit(_FIRST_DAY).cast("date"), n)
        y = F.date_format(moved, "yyyy")
        mo, d = (F.when(padded, F.date_format(moved, x * 2)).otherwise(F.date_format(moved, x)) for x in "Md")
        return F.when(year_first, F.concat(y, sep, mo, sep, d)).when(slash != swapped, F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))

    return F.when(usual.isNotNull(), let(permuted_day(usual, key), lambda n: shown(n, False))).when(other.isNotNull(), let(permuted_day(other, key, late=True), lambda n: shown(n, True)))


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.").cast("array<int>")
    out = feistel(octets, F.array(*[F.lit(256)] * 4), key, F.lit("ip"))
    return F.array_join(out.cast("array<string>"), ".")


def _laid(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits``, in order."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    place = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), r"\D", ""))
    return let(digits, lambda w: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substr(w, place(i), F.lit(1))).otherwise(c)), ""))


def _phone(m: Column, key: str) -> Column:
    """The number's digits without country code and trunk 0 are permuted, whatever stands between them: its written forms stay linked."""
    bracketed = m.rlike(rf"^{_BRACKETS}$") & ~m.contains("(0")
    # What stays: the country code and a trunk 0.
    code = rf"^(?:(?:\+|00)(?:1|{_COUNTRY})|1(?=[ .-]))?[ .-]*(?:\(0\)|\(?0)?[ ./-]*\(?"
    head = F.when(bracketed, F.regexp_extract(m, r"^[^(]*\(", 0)).otherwise(F.regexp_extract(m, code, 0))
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    digits = F.regexp_replace(rest, r"\D", "")
    moved = F.concat(head, _laid(rest, _permuted(digits, key, "phone", first=[0], leads=("0", "1", "23456789"))))
    n = F.length(F.regexp_replace(m, r"^00|\D", ""))
    good = F.when(m.rlike(r"^\(?0(?!0)"), n.between(9, 12)).otherwise(n.between(8, 15))
    return F.when(good, moved)


def _email(m: Column, key: str) -> Column:
    top = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(_permuted(F.substr(m, F.lit(1), F.length(m) - F.length(top)), key, "email"), top)


def _named(m: Column, key: str, kind: str, symbols: str = "") -> Column:
    """What follows "name =", "name:" or "bearer", from its first to its last character that has an alphabet."""
    head = F.regexp_extract(m, r"^(?:(?i:bearer)\s+|[^=:]*[=:]\s*)", 0)
    value = F.substr(m, F.length(head) + 1, F.length(m))
    start = F.regexp_extract(value, rf"^[^A-Za-z0-9{symbols}]*", 0)
    body = F.regexp_extract(value, rf"(?s)[A-Za-z0-9{symbols}](?:.*[A-Za-z0-9{symbols}])?", 0)
    tail = F.substr(value, F.length(start) + F.length(body) + 1, F.length(value))
    return F.concat(head, start, _permuted(body, key, kind, hexadecimal=body.rlike("^[0-9a-f]+$"), symbols=symbols), tail)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match; null if it isn't valid."""
    is_a = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(is_a("email"), _email(m, key))
        .when(is_a("phone"), _phone(m, key))
        .when(is_a("ip"), _ip(m, key))
        .when(is_a("date"), _date(m, key))
        .when(is_a("card"), _card(m, key))
        .when(is_a("key"), F.concat(F.lit("AKIA"), _permuted(F.substr(m, F.lit(5), F.lit(16)), key, "key")))
        .when(is_a("token"), _named(m, key, "token"))
        .when(is_a("password"), _named(m, key, "password", _SYMBOLS))
    )


def session_key(spark: SparkSession) -> str:
    """The session's secret key, or the demonstration key."""
    return spark.conf.get(KEY_SETTING, None) or DEMO_KEY


def pseudonymise(df: DataFrame, *, key: str, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``df`` with its text replaced, and <prefix>values and <prefix>invalid (counts) in last columns."""
    at = df.columns.index(text)
    plain = df.toDF(*[f"in_{i}" for i in range(len(df.columns))])
    body = F.col(f"in_{at}")
    # Every pattern needs one of these characters; other texts are left at once.
    some = plain.withColumn("found", F.when(body.rlike("[0-9@=:]"), F.regexp_extract_all(body, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = some.withColumn("made", F.transform("found", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    gaps = F.split(body, _ANY)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("made", i)["new"], F.get("made", i)["old"], F.lit("")))), "")
    new = F.when(F.size("found") > 0, joined).otherwise(body)
    count = lambda good: F.size(F.filter("made", lambda x: x["new"].isNotNull() if good else x["new"].isNull())).cast("long")
    columns = [new.alias(f"in_{at}") if i == at else F.col(f"in_{i}") for i in range(len(df.columns))]
    out = some.select(*columns, F.when(body.isNotNull(), count(True)).otherwise(0).alias("n_good"), F.when(body.isNotNull(), count(False)).otherwise(0).alias("n_bad"))
    return out.toDF(*df.columns, f"{prefix}values", f"{prefix}invalid")


def pseudonymised(df: DataFrame, *, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, pii_values, pii_invalid, for every document."""
    return pseudonymise(pick(df, doc_id=doc_id, text=text), key=key)

"""Format-preserving pseudonyms for personal numbers, dates and addresses of e-mail.

Built-in expressions only.  One pattern finds all candidates; each is validated (Luhn,
mod 97, octet ranges, calendar, number of digits, issued ranges) and, if valid, replaced
by a keyed Feistel permutation of its own format, so that equal values get equal
pseudonyms in all documents, and pseudonyms are valid again:

* cards: all digits but the last permuted, the Luhn digit recomputed
* IBANs: the account part permuted (letters to letters, digits to digits), check digits recomputed
* social security numbers: permuted within the issued area, group and serial ranges
* telephone numbers: the digits after the country code
* IPv4 addresses: the 32-bit value
* dates: the day number within its century; numeric dates are read day first where valid
* e-mail addresses: the letters and digits of the local part

Punctuation and widths are kept; what fails validation stays as it is, and a text
without valid candidates is returned unchanged.

Defined cases: null text counts as empty; empty and very long texts, repeated rows and null ids
are rewritten like any other; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free_name, whole_text

#: Demonstration key; pass a secret one in production.
DEMO_KEY = "quillon-demo-key"
ROUNDS = 10

_EDGE, _END = r"(?<![0-9A-Za-z_.+-])", r"(?![0-9A-Za-z_]|[.-][0-9])"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"{_EDGE}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{_END}",
    "card": rf"{_EDGE}(?:[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}|3[0-9]{{3}}([ -])[0-9]{{6}}\2[0-9]{{5}}|[0-9]{{13,19}}){_END}",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?){_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "iso": rf"{_EDGE}[0-9]{{4}}([-/.])[0-9]{{1,2}}\3[0-9]{{1,2}}{_END}",
    "numeric": rf"{_EDGE}[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\4(?:[0-9]{{4}}|[0-9]{{2}}){_END}",
    "day_month": rf"{_EDGE}[0-9]{{1,2}} {_MONTH},? [0-9]{{4}}{_END}",
    "month_day": rf"{_EDGE}{_MONTH} [0-9]{{1,2}},? [0-9]{{4}}{_END}",
    "phone": rf"(?<![0-9A-Za-z_.+-])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\) ?|[0-9]{{2,5}}[ .-])[0-9]{{2,5}}(?:[ .-][0-9]{{2,5}}){{1,3}}{_END}|(?<![0-9A-Za-z_.+-])\+[0-9]{{8,15}}{_END}",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_FULL = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _span(first: Column, last: Column) -> Column:
    """Ascending sequence, empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _number(h: Column, width: int = 13) -> Column:
    return F.conv(F.substring(h, 1, width), 16, 10).cast("long")


def feistel_pair(a: Column, b: Column, n1: Column | int, n2: Column | int, key: str, kind: str) -> Column:
    """Keyed permutation of pairs (a, b) in [0, n1) x [0, n2); struct of longs."""
    n1, n2 = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (n1, n2))

    def step(s: Column, r: Column) -> Column:
        def mixed(other: Column) -> Column:
            return _number(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), n1, n2, r, other).cast("binary"), 256))

        return F.when(r % 2 == 0, F.struct(F.pmod(s["a"] + mixed(s["b"]), n1).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), F.pmod(s["b"] + mixed(s["a"]), n2).alias("b"))
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the digits and letters (A-Z, a-z) of a short text, each within its class."""

    def moved(c: Column, k: Column) -> Column:
        code = F.ascii(c)

        def within(first: str, n: int) -> Column:
            return F.char(F.pmod(code - ord(first) + k, F.lit(n)) + ord(first))

        return (
            F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)
        )

    def step(s: Column, r: Column) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), r, F.length(s["a"]), s["b"]).cast("binary"), 512)
        new = _let(h, lambda h: F.array_join(F.transform(_chars(s["a"]), lambda c, i: moved(c, F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))), ""))
        return F.struct(s["b"].alias("a"), new.alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, symbols: Column, kind: str = "[^0-9]") -> Column:
    """``shape`` with its digits (or what ``kind`` does not exclude) replaced, in order, by ``symbols``."""

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), kind, ""))
        return F.when(c.rlike(kind), c).otherwise(F.substring(symbols, before, F.lit(1)))

    return F.array_join(F.transform(_span(F.lit(1), F.length(shape)), at), "")


def _luhn(payload: Column) -> Column:
    """Check digit (int) of a string of digits."""

    def weigh(total: Column, c: Column) -> Column:
        d = F.ascii(c) - 48
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.struct((total["sum"] + F.when(total["odd"], doubled).otherwise(d)).alias("sum"), (~total["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(F.reverse(_chars(payload)), start, weigh, lambda s: F.pmod(-s["sum"], F.lit(10)))


def _mod97(text: Column) -> Column:
    def add(rest: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = (_luhn(payload).cast("string") == F.substring(d, F.length(d), F.lit(1))) & (F.replace(d, F.lit("0"), F.lit("")) != "")
        moved = _let(feistel_text(payload, key, "card"), lambda p: F.concat(p, _luhn(p).cast("string")))
        return F.when(valid, _let(moved, lambda x: _refill(m, x)))

    return _let(_digits(m), new)


def _iban(m: Column, key: str) -> Column:
    def new(t: Column) -> Column:
        country, account = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t))
        valid = (F.length(t).between(15, 34)) & (_mod97(F.concat(account, F.substring(t, 1, 4))) == 1)
        moved = _let(
            feistel_text(account, key, "iban"),
            lambda a: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a),
        )
        return F.when(valid, _let(moved, lambda x: _refill(m, x, "[^0-9A-Z]")))

    return _let(F.replace(m, F.lit(" "), F.lit("")), new)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    b = (group - 1) * 9999 + serial - 1

    def shown(s: Column) -> Column:
        new = F.when(s["a"] + 1 >= 666, s["a"] + 2).otherwise(s["a"] + 1)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", pad(new, 3), pad(F.floor(s["b"] / 9999) + 1, 2), pad(s["b"] % 9999 + 1, 4))

    return F.when(valid, _let(feistel_pair(a, b, 898, 99 * 9999, key, "ssn"), shown))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        valid = F.forall(o, lambda x: x <= 255)
        pair = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return F.when(valid, _let(pair, lambda s: F.concat_ws(".", *[c.cast("string") for h in (s["a"], s["b"]) for c in (F.floor(h / 256), h % 256)])))

    return _let(F.transform(F.split(m, "[.]"), lambda x: x.cast("int")), new)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    valid = F.length(_digits(m)).between(9, 15) & (F.length(_digits(rest)) >= 7)
    return F.when(valid, _let(feistel_text(_digits(rest), key, "phone"), lambda d: F.concat(country, _refill(rest, d))))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _moved_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """The permuted date of a valid date in the same century, else null."""
    date = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    century = F.floor(year / 100).cast("int")
    start = F.try_make_timestamp(century * 100, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    leap = century % 4 == 0  # 36525 = 75 * 487 days, else 36524 = 92 * 397
    n1, n2 = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    at = F.datediff(date, start)
    moved = feistel_pair(F.floor(at / n2), at % n2, n1, n2, key, "date")
    return F.when(date.isNotNull() & (year >= 1000), _let(moved, lambda s: F.date_add(start, (s["a"] * n2 + s["b"]).cast("int"))))


def _padded(value: Column, old: Column) -> Column:
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(old), F.length(text)), F.lit("0"))


def _numeric_date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, "[-/.]", 0)

    def new(p: Column) -> Column:
        iso = F.length(p[0]) == 4
        year_text = F.when(iso, p[0]).otherwise(p[2])
        year = F.when(F.length(year_text) == 2, year_text.cast("int") + 2000).otherwise(year_text.cast("int"))
        first, second = F.when(iso, p[1]).otherwise(p[0]), F.when(iso, p[2]).otherwise(p[1])
        day_first = ~iso & (second.cast("int") <= 12)
        month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)

        def shown(d: Column) -> Column:
            a, b = F.when(day_first, F.day(d)).otherwise(F.month(d)), F.when(day_first, F.month(d)).otherwise(F.day(d))
            y = F.when(F.length(year_text) == 2, F.lpad((F.year(d) % 100).cast("string"), 2, "0")).otherwise(F.year(d).cast("string"))
            return F.when(iso, F.concat(y, sep, _padded(a, first), sep, _padded(b, second))).otherwise(F.concat(_padded(a, first), sep, _padded(b, second), sep, y))

        return _let(_moved_day(year, month.cast("int"), day.cast("int"), key), lambda d: F.when(d.isNotNull(), shown(d)))

    return _let(F.split(m, "[-/.]"), new)


def _named_date(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, "[A-Za-z]+", 0)
    month = F.array_position(F.lit(MONTHS), F.lower(F.substring(name, 1, 3))).cast("int")
    day, year = F.regexp_extract(m, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1), F.regexp_extract(m, "[0-9]{4}", 0)

    def shown(d: Column) -> Column:
        full = F.get(F.lit(_FULL), F.month(d) - 1)
        written = F.when(F.length(name) == 3, F.substring(full, 1, 3)).otherwise(full)
        comma, new_day = F.when(m.contains(","), F.lit(", ")).otherwise(F.lit(" ")), _padded(F.day(d), day)
        parts = F.when(m.rlike("^[0-9]"), F.concat(new_day, F.lit(" "), written)).otherwise(F.concat(written, F.lit(" "), new_day))
        return F.concat(parts, comma, F.year(d).cast("string"))

    return _let(_moved_day(year.cast("int"), month, day.cast("int"), key), lambda d: F.when(d.isNotNull(), shown(d)))


_RULES = (
    ("email", r"@", _email),
    ("ip", r"^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$", _ip),
    ("card", r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5})$", _card),
    ("iban", r"^[A-Z]{2}[0-9]{2}", _iban),
    ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    ("date", r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:[0-9]{4}|[0-9]{2}))$", _numeric_date),
    ("date", r"[A-Za-z]{3}", _named_date),
    ("phone", r"", _phone),
)


def pseudonym(m: Column, key: str = DEMO_KEY) -> Column:
    """struct(kind, new): the pseudonym of one candidate, new null if it is not valid."""
    rule = None
    for kind, shape, make in _RULES:
        value = F.struct(F.lit(kind).alias("kind"), make(m, key).alias("new"))
        rule = F.when(m.rlike(shape), value) if rule is None else rule.when(m.rlike(shape), value) if shape else rule.otherwise(value)
    return rule


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, plus ``__kinds`` (kinds of the values replaced, in order).

    Where ``docs`` has a column of that name, the new one has underscores appended.
    """
    text, found_col, kinds_col = whole_text(text_col), free_name(docs, "__found"), free_name(docs, "__kinds")
    hit = text.rlike(PATTERN)
    none = F.array().cast("array<struct<m:string,kind:string,new:string>>")

    def one(m: Column) -> Column:
        return _let(pseudonym(m, key), lambda p: F.struct(m.alias("m"), p["kind"].alias("kind"), p["new"].alias("new")))

    found = F.when(hit, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), one)).otherwise(none)
    parts = F.split(text, PATTERN, -1)
    pieces = F.zip_with(parts, F.col(found_col), lambda part, f: F.concat(part, F.coalesce(f["new"], f["m"], F.lit(""))))
    changed = F.exists(found_col, lambda f: f["new"].isNotNull())
    return (
        docs.withColumn(found_col, found)
        .withColumn(text_col, F.when(changed, F.array_join(pieces, "")).otherwise(text))
        .withColumn(kinds_col, F.transform(F.filter(found_col, lambda f: f["new"].isNotNull()), lambda f: f["kind"]))
        .drop(found_col)
    )


def _equals(name: str) -> Callable[[Column], Column]:
    return lambda kind: kind == name


def rewritten(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """doc_id, rewritten text and the number of replaced values by kind."""
    kinds = ["email", "ip", "card", "iban", "ssn", "date", "phone"]
    counts = [F.size(F.filter("__kinds", _equals(name))).cast("long").alias(f"n_{name}") for name in kinds]
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", "text", F.size("__kinds").cast("long").alias("n_replaced"), *counts)

"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds candidates, and one more, in what lies between them, runs of digit groups, of which cards
are the valid stretches; each is validated (card and IBAN checksums, ranges of addresses, real dates) and put through a keyed Feistel network over its own format, so that equal values get equal pseudonyms in all documents
and different values different ones:

* text-like values: the symbols at odd and at even places are the two halves; a round adds to each symbol of one half,
  within the symbol's own alphabet (digits, small, capital or hexadecimal letters), a digit of SHA-512 of key, kind,
  round and the other half. Separators stay where they are and take no part.
* dates, addresses and social security numbers: a pair of numbers in Z_a x Z_b that counts exactly the valid values.

Check digits are computed anew. The key's holder can undo all of it; nobody else learns more than equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
_START, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried, with the pattern of a whole value.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_~-]{8,}",
    "key": _START + r"AKIA[0-9A-Z]{16}" + _END,
    "iban": _START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "iso_date": _START + r"(?:18|19|20|21)[0-9]{2}-[01][0-9]-[0-3][0-9]" + _END,
    "day_date": _START + "(?:" + "|".join(rf"[0-3]?[0-9]{s}[0-3]?[0-9]{s}(?:18|19|20|21)[0-9]{{2}}" for s in (r"\.", "/")) + ")" + _END,
    "ssn": _START + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})" + _END,
    "card": r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "ip": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
}
_ANY = "|".join(pattern for kind, pattern in KINDS.items() if kind != "card")
#: Groups of digits, 13 digits at least, with a blank or hyphen between groups. Cards are looked for within.
_RUN = r"(?<![0-9A-Za-z.])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
_MARK, _ESCAPE = "\u0001", "\u0002"

#: How cards are grouped, after the blank before them.
_GROUPED = r"\A[ -]?(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(s: str) -> Column:
    return F.lit(s)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def seal_text(value: Column, kind: str, key: str, fixed: Callable[[Column, Column], Column] | None = None) -> Column:
    """The Feistel network over the symbols of value. fixed(place from 0, length): places that stay as they are."""

    def round_(s: Column, r: Column) -> Column:
        n = F.length(s)
        places = F.sequence(F.lit(0), n - 1)
        symbol = lambda i: F.substr(s, i + 1, F.lit(1))
        moves = lambda i: F.pmod(i + r, F.lit(2)) == 0
        half = F.array_join(F.transform(places, lambda i: F.when(moves(i), _text("")).otherwise(symbol(i))), "")
        is_hex = s.rlike(r"\A[0-9a-f]{16,}\z")

        def moved(i: Column, h: Column) -> Column:
            c = symbol(i)
            add = _number(F.substr(h, F.pmod(F.floor(i / 2), F.lit(32)).cast("int") * 4 + 1, F.lit(4)))
            first = F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[a-z]"), F.lit(97)).when(c.rlike("[A-Z]"), F.lit(65))
            base = F.when(c.rlike("[0-9]"), F.lit(10)).when(is_hex, F.lit(6)).otherwise(F.lit(26))
            free = moves(i) & first.isNotNull()
            if fixed is not None:
                free = free & ~fixed(i, n)
            return F.when(free, F.char(first + F.pmod(F.ascii(c) - first + add, base))).otherwise(c)

        seed = F.sha2(F.concat(_text(f"{key}|{kind}|"), r.cast("string"), _text("|"), half), 512)
        return _let(seed, lambda h: F.array_join(F.transform(places, lambda i: moved(i, h)), ""))

    return F.when(F.length(value) > 0, F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), value, round_)).otherwise(value)


def seal_pair(left: Column, right: Column, a: int, b: int, kind: str, key: str, then: Callable[[Column, Column], Column]) -> Column:
    """The Feistel network over Z_a x Z_b; then(left, right) makes the result."""

    def round_(s: Column, r: Column) -> Column:
        def drawn(other: Column) -> Column:
            return _number(F.substring(F.sha2(F.concat(_text(f"{key}|{kind}|"), r.cast("string"), _text("|"), other.cast("string")), 256), 1, 12))

        turn = F.pmod(r, F.lit(2)) == 0
        x = F.when(turn, F.pmod(s["x"] + drawn(s["y"]), F.lit(a))).otherwise(s["x"]).cast("long")
        y = F.when(turn, s["y"]).otherwise(F.pmod(s["y"] + drawn(s["x"]), F.lit(b))).cast("long")
        return F.struct(x.alias("x"), y.alias("y"))

    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, round_, lambda s: then(s["x"], s["y"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _poured(layout: Column, symbols: Column, pattern: str = "[0-9]") -> Column:
    """layout with the symbols that match pattern replaced, in order, by symbols."""

    def at(i: Column) -> Column:
        c = F.substr(layout, i, F.lit(1))
        count = F.length(F.regexp_replace(F.substr(layout, F.lit(1), i), pattern.replace("[", "[^"), ""))
        return F.when(c.rlike(pattern), F.substr(symbols, count, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), at), "")


def _cards_marked(run: Column) -> Column:
    """run with marks around cards: from left to right, each longest stretch of whole groups, of 13 to 19 digits, that is valid.

    One that is grouped as cards are goes before one that isn't, which may be valid by chance across a card's edge.
    """

    def within(groups: Column, blanks: Column) -> Column:
        n = F.size(groups)
        written = lambda k, size: F.array_join(F.zip_with(F.slice(blanks, k, size), F.slice(groups, k, size), lambda a, b: F.concat(a, b)), "")
        blank = lambda k: F.element_at(blanks, k)

        def valid(k: Column, size: Column) -> Column:
            return _let(F.array_join(F.slice(groups, k, size), ""), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))

        sizes = lambda k: F.sequence(F.least(F.lit(19), n - k + 1), F.lit(1), F.lit(-1))
        card = lambda k, size: valid(k, size) & written(k, size).rlike(_GROUPED)
        later = lambda k, size: F.filter(F.sequence(k, k + size - 1), lambda j: j > k)
        cuts = lambda k, size: F.exists(later(k, size), lambda j: F.exists(sizes(j), lambda t: card(j, t)))

        def step(s: Column, k: Column) -> Column:
            found = F.get(F.concat(F.filter(sizes(k), lambda size: card(k, size)), F.filter(sizes(k), lambda size: valid(k, size) & ~cuts(k, size))), F.lit(0))

            def grown(size: Column) -> Column:
                marked = F.concat(blank(k), _text(_MARK), F.substr(written(k, size), F.length(blank(k)) + 1), _text(_MARK))
                out = F.when(size.isNull(), written(k, F.lit(1))).otherwise(marked)
                return F.struct(F.concat(s["out"], out).alias("out"), (k + F.coalesce(size, F.lit(1))).alias("next"))

            return F.when(k < s["next"], s).otherwise(_let(found, grown))

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(_text("").alias("out"), F.lit(1).alias("next")), step, lambda s: s["out"])

    # What stands before each group; nothing before the first.
    return _let(F.struct(F.split(run, "[ -]").alias("groups"), F.split(run, "[0-9]+").alias("blanks")), lambda s: within(s["groups"], s["blanks"]))


def _card(v: Column, key: str) -> Column:
    def renew(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        sealed = seal_text(body, "card", key, lambda i, n: i == 0)
        return _let(sealed, lambda p: F.concat(p, F.element_at(F.filter(F.array(*[_text(str(x)) for x in range(10)]), lambda c: F.call_function("luhn_check", F.concat(p, c))), 1)))

    return _let(_digits(v), lambda d: F.when(F.call_function("luhn_check", d), _poured(v, renew(d))).otherwise(v))


def _iban(v: Column, key: str) -> Column:
    """Validated modulo 97 (ISO 7064), check digits renewed; the country stays."""

    def mod97(s: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substr(s, i, F.lit(1))))
        step = lambda r, c: F.when(c < 58, F.pmod(r * 10 + c - 48, F.lit(97))).otherwise(F.pmod(r * 100 + c - 55, F.lit(97)))
        return F.aggregate(codes, F.lit(0), lambda r, c: step(r, c).cast("int"))

    def renew(s: Column) -> Column:
        country = F.substring(s, 1, 2)
        sealed = seal_text(F.substr(s, F.lit(5), F.length(s)), "iban", key)
        return _let(sealed, lambda p: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(p, country, _text("00")))).cast("string"), 2, "0"), p))

    s = F.replace(v, _text(" "), _text(""))
    return _let(s, lambda s: F.when((F.length(s) >= 15) & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1), _poured(v, renew(s), "[0-9A-Z]")).otherwise(v))


#: The Gregorian cycle of 400 years from 1800-01-01 has 146,097 = 189 * 773 days.
_DAYS = (189, 773)


def _date(iso: Column, key: str, show: Callable[[Column], Column], v: Column) -> Column:
    day = F.datediff(F.try_to_timestamp(iso, _text("yyyy-MM-dd")).cast("date"), F.lit("1800-01-01").cast("date"))
    sealed = lambda n: seal_pair(F.floor(n / _DAYS[1]), F.pmod(n, F.lit(_DAYS[1])), *_DAYS, "date", key, lambda x, y: show(F.date_add(F.lit("1800-01-01").cast("date"), (x * _DAYS[1] + y).cast("int"))))
    return _let(day, lambda n: F.when(n.isNotNull() & (n >= 0) & (n < _DAYS[0] * _DAYS[1]), sealed(n)).otherwise(v))


def _day_date(v: Column, key: str) -> Column:
    """Day and month in either order: the first number is the month only if written with / and the second can't be one,
    or neither exceeds 12 and / is used."""
    parts = F.split(v, "[./]")
    a, b, year = (F.element_at(parts, k) for k in (1, 2, 3))
    slash = v.contains("/")
    month_first = slash & (a.cast("int") <= 12)
    sep = F.when(slash, _text("/")).otherwise(_text("."))
    iso = F.concat(year, _text("-"), F.lpad(F.when(month_first, a).otherwise(b), 2, "0"), _text("-"), F.lpad(F.when(month_first, b).otherwise(a), 2, "0"))

    def show(d: Column) -> Column:
        m, day = F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")
        # Where the order is told by the numbers alone, the pseudonym is written month first as well.
        return F.concat(F.when(month_first, m).otherwise(day), sep, F.when(month_first, day).otherwise(m), sep, F.lpad(F.year(d).cast("string"), 4, "0"))

    return _date(iso, key, show, v)


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    at = lambda k: F.element_at(o, k)
    high, low = lambda n: F.floor(n / 256).cast("int").cast("string"), lambda n: F.pmod(n, F.lit(256)).cast("string")
    return seal_pair(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, "ip", key, lambda x, y: F.concat_ws(".", high(x), low(x), high(y), low(y)))


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(v, "-"), k).cast("int") for k in (1, 2, 3))
    x0 = area - 1 - F.when(area > 666, 1).otherwise(0)
    y0 = (group - 1) * 9999 + serial - 1
    pad = lambda n, k: F.lpad(n.cast("string"), k, "0")

    def show(x: Column, y: Column) -> Column:
        return F.concat(pad(x + 1 + F.when(x >= 665, 1).otherwise(0), 3), _text("-"), pad(F.floor(y / 9999) + 1, 2), _text("-"), pad(F.pmod(y, F.lit(9999)) + 1, 4))

    return seal_pair(x0, y0, 898, 99 * 9999, "ssn", key, show)


def _phone(v: Column, key: str) -> Column:
    """The country code stays; the same number in another layout has the same pseudonym digits."""
    country = F.coalesce(F.nullif(F.regexp_extract(v, r"\A(\+[1-9][0-9]{0,2})(?=[^0-9])", 1), _text("")), F.when(v.startswith("+"), F.substring(v, 1, 2)), _text(""))
    rest = F.substr(v, F.length(country) + 1, F.length(v))
    return _let(rest, lambda rest: F.concat(country, _poured(rest, seal_text(_digits(rest), "phone", key))))


def _email(v: Column, key: str) -> Column:
    """Everything but the top-level domain; letters become small."""
    dot = lambda s: F.length(s) - F.length(F.substring_index(s, ".", -1))
    return _let(F.lower(v), lambda s: F.concat(seal_text(F.substr(s, F.lit(1), dot(s)), "email", key), F.substring_index(s, ".", -1)))


def _secret(v: Column, key: str) -> Column:
    name = F.regexp_extract(v, r"(?s)\A(.*?[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_~-]{8,}\z", 1)
    return F.concat(name, seal_text(F.substr(v, F.length(name) + 1, F.length(v)), "secret", key))


def _key(v: Column, key: str) -> Column:
    return F.concat(_text("AKIA"), seal_text(F.substr(v, F.lit(5), F.length(v)), "key", key))


_SEALED: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "key": _key, "iban": _iban, "iso_date": lambda v, key: _date(v, key, lambda d: F.date_format(d, "yyyy-MM-dd"), v), "day_date": _day_date,
    "ssn": _ssn, "phone": _phone, "card": _card, "ip": _ip,
}


def _pseudonym(v: Column, key: str) -> Column:
    out = v
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(v.rlike(rf"\A(?:{pattern})\z"), _SEALED[kind](v, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with pseudonyms in ``text``; all other columns stay. count: name of a column to add, values replaced.

    A null text stays null, with count 0; an empty one stays empty; repeated rows stay repeated; other columns, whatever
    their names, and an empty table stay as they are. A text without personal data stays as it is, byte for byte.
    A card, IBAN or date that isn't valid is no such value and stays.
    """
    parts, found = fresh("_pii_parts", docs.columns), fresh("_pii_out", docs.columns)
    # The marks' own characters are escaped where a text has them.
    escaped = F.replace(F.replace(F.col("text"), _text(_ESCAPE), _text(_ESCAPE + ":")), _text(_MARK), _text(_ESCAPE + ";"))
    safe = F.when(F.col("text").rlike(f"[{_MARK}{_ESCAPE}]"), escaped).otherwise(F.col("text"))
    # A literal of Java's replacement syntax: $0 is the whole match.
    split = lambda s, pattern: F.split(F.regexp_replace(s, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    odd = lambda i: F.pmod(i, F.lit(2)) == 1
    with_cards = lambda p: F.split(F.array_join(F.transform(split(p, _RUN), lambda r, i: F.when(odd(i), _cards_marked(r)).otherwise(r)), ""), _MARK, -1)
    # A piece between values becomes an odd number of pieces, so that values stay at odd places.
    pieces = F.transform(split(safe, _ANY), lambda p, i: F.when(~odd(i) & p.rlike(_RUN), with_cards(p)).otherwise(F.array(p)))
    marked = docs.withColumn(parts, F.flatten(pieces))
    sealed = F.transform(F.col(parts), lambda p, i: F.when(odd(i), _pseudonym(p, key)).otherwise(p))
    out = marked.withColumn(found, F.when(F.size(parts) > 1, sealed))
    joined = F.array_join(F.col(found), "")
    joined = F.when(joined.contains(_ESCAPE), F.replace(F.replace(joined, _text(_ESCAPE + ";"), _text(_MARK)), _text(_ESCAPE + ":"), _text(_ESCAPE))).otherwise(joined)
    if count is not None:
        changed = F.size(F.filter(F.zip_with(F.col(parts), F.col(found), lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count, F.when(F.col(found).isNotNull(), changed).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col(found).isNotNull(), joined).otherwise(F.col("text"))).drop(parts, found)

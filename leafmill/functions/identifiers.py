"""Grammars of the identifiers that envelopes and type maps carry, as patterns that Spark and Python read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"[a-z0-9]+(?:-[a-z0-9]+)*"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"
_LAST = rf"(?:{_H}:{_H}|{_IPV4})"
#: By how many groups stand before a double colon.
_IPV6 = "(?:" + "|".join([rf"(?:{_H}:){{6}}{_LAST}", *(rf"(?:(?:{_H}:){{0,{k - 1}}}{_H})?::(?:{_H}:){{{5 - k}}}{_LAST}" if k else rf"::(?:{_H}:){{5}}{_LAST}" for k in range(6)), rf"(?:(?:{_H}:){{0,5}}{_H})?::{_H}", rf"(?:(?:{_H}:){{0,6}}{_H})?::"]) + ")"
_FREE, _SUB, _COLON, _PERCENT = r"A-Za-z0-9._~", r"!$&'()*+,;=", ":", r"%[0-9A-Fa-f]{2}"


def _run(more: str = "") -> str:
    return rf"(?:[{_FREE}{_SUB}{more}-]|{_PERCENT})*"


_HOST = rf"(?:\[(?:{_IPV6}|[vV][0-9A-Fa-f]+\.[{_FREE}{_SUB}:-]+)\]|{_run()})"
_HIERARCHY = rf"(?://(?:{_run(_COLON)}@)?{_HOST}(?::[0-9]*)?(?:/{_run(':@/')})?|(?!//)(?=[^?#]){_run(':@/')})"

# The forms of identifiers.
PATTERNS = {
    "record_type": rf"{_PART}(?:\.{_PART})+",
    "content_id": r"sha256:[0-9a-f]{64}",
    "version": r"[0-9]+\.[0-9]+\.[0-9]+",
    "registry": r"0x[0-9a-fA-F]{40}",
    "transaction": r"0x[0-9a-fA-F]{64}",
    "uri": rf"[A-Za-z][A-Za-z0-9+.-]*:{_HIERARCHY}(?:\?{_run(':@/?')})?(?:#{_run(':@/?')})?",
    "date_time": r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[Tt ](?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_LONG_MONTHS, _ZONE = (1, 3, 5, 7, 8, 10, 12), re.compile(r"([+-])([0-9]{2}):?([0-9]{2})?$")


def _real_date_time(s: str) -> bool:
    """Whether the day is in its month, and a 60th second at the end of a day in UTC."""
    year, month, day = int(s[:4]), int(s[5:7]), int(s[8:10])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if day > (31 if month in _LONG_MONTHS else 30 if month != 2 else 29 if leap else 28):
        return False
    if s[17:19] != "60":
        return True
    zone = _ZONE.search(s[19:])
    ahead = (int(zone[2]) * 60 + int(zone[3] or 0)) * (-1 if zone[1] == "-" else 1) if zone else 0
    return (int(s[11:13]) * 60 + int(s[14:16]) - ahead) % 1440 == 1439


def fits(kind: str, s: object) -> bool:
    return isinstance(s, str) and _COMPILED[kind].fullmatch(s) is not None and (kind != "date_time" or _real_date_time(s))


def is_a(kind: str, s: Column) -> Column:
    """Whether a text has the form of a kind of PATTERNS; false for null."""
    good = s.rlike(rf"\A(?:{PATTERNS[kind]})\z")
    if kind == "date_time":
        number = lambda at, n: F.substring(s, at, n).cast("int")
        day = F.make_date(number(1, 4), number(6, 2), F.lit(1))
        zone = F.regexp_extract(s, r"([+-][0-9]{2}):?[0-9]{0,2}$", 1)
        minutes = F.coalesce(F.regexp_extract(s, r"[+-][0-9]{2}:?([0-9]{2})$", 1).try_cast("int"), F.lit(0))
        ahead = F.when(F.length(s) > 19, F.coalesce((F.abs(zone.try_cast("int")) * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0)))
        last = F.pmod(number(12, 2) * 60 + number(15, 2) - ahead, F.lit(1440)) == 1439
        good = F.when(good, (number(9, 2) <= F.dayofmonth(F.last_day(day))) & ((F.substring(s, 18, 2) != "60") | last))
    return F.coalesce(good, F.lit(False))

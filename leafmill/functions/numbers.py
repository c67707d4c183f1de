"""Canonical forms of number literals, of any precision, as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.constants import MAX_DIGITS

# The grammars of number literals.
_INTEGER = r"\A-?(?:0|[1-9][0-9]*)\z"
_DECIMAL = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"


def integer_reason(s: Column) -> Column:
    return F.when(~s.rlike(_INTEGER), F.lit("integer-grammar")).when(F.length(F.ltrim(s, F.lit("-"))) > MAX_DIGITS, F.lit("digit-bound-exceeded"))


def canonical_integer(s: Column) -> Column:
    """The integer without the sign of zero; null where ``integer_reason`` gives a reason."""
    return F.when(integer_reason(s).isNull(), F.when(s == "-0", F.lit("0")).otherwise(s))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of values, each of which is evaluated once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _parts(s: Column, body: Callable[[Column], Column]) -> Column:
    """body of what a literal that fits the grammar is made of, without another regular expression: minus, digits, where
    the point stands among them, and whether the number is within the bound."""

    def numbers(t: Column) -> Column:
        # An exponent of more than six digits is beyond the bound whatever the rest; it isn't converted.
        huge = F.length(t["size"]) > 6
        e = F.when(huge | (t["size"] == ""), F.lit(0)).otherwise(t["size"].cast("int"))
        whole = F.length(F.substring_index(t["unsigned"], ".", 1))
        return _let({"minus": t["minus"], "digits": F.replace(t["unsigned"], F.lit("."), F.lit("")), "point": whole + F.when(t["down"], -e).otherwise(e), "huge": huge}, bounded)

    def bounded(p: Column) -> Column:
        n = F.length(p["digits"])
        fits = ~p["huge"] & (F.greatest(n, p["point"], n - p["point"]) <= MAX_DIGITS)
        return F.when(fits, body(p))

    def split(t: Column) -> Column:
        return _let({"minus": t["mantissa"].startswith("-"), "unsigned": F.ltrim(t["mantissa"], F.lit("-")), "down": t["exponent"].startswith("-"), "size": F.ltrim(F.ltrim(t["exponent"], F.lit("+-")), F.lit("0"))}, numbers)

    at = F.instr(F.lower(s), "e")
    end = F.when(at > 0, at).otherwise(F.length(s) + 1)
    return _let({"mantissa": F.substr(s, F.lit(1), end - 1), "exponent": F.substr(s, end + 1, F.length(s))}, split)


#: Most literals have no exponent and few digits; they are canonical but for the sign of zero.
_PLAIN, _MINUS_ZERO = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z", r"\A-0(?:\.0+)?\z"


def _plain(s: Column) -> Column:
    return s.rlike(_PLAIN) & (F.length(s) <= MAX_DIGITS)


def decimal_reason(s: Column) -> Column:
    other = F.when(~s.rlike(_DECIMAL), F.lit("decimal-grammar")).when(_parts(s, lambda _: F.lit(True)).isNull(), F.lit("digit-bound-exceeded"))
    return F.when(~_plain(s), other)


def canonical_decimal(s: Column) -> Column:
    """Positional digits: the exponent carried out, zeros of the fraction kept, zero without sign; null where
    ``decimal_reason`` gives a reason."""

    def expanded(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        some = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), n))
        whole = F.ltrim(F.when(point > 0, F.concat(F.substr(digits, F.lit(1), point), some(point - F.length(digits)))).otherwise(F.lit("")), F.lit("0"))
        fraction = F.when(point > 0, F.substr(digits, point + 1, F.length(digits))).otherwise(F.concat(some(-point), digits))
        sign = F.when(p["minus"] & (F.ltrim(digits, F.lit("0")) != ""), F.lit("-")).otherwise(F.lit(""))
        return _let({"s": sign, "w": whole, "f": fraction}, lambda t: F.concat(t["s"], F.when(t["w"] == "", F.lit("0")).otherwise(t["w"]), F.when(t["f"] == "", F.lit("")).otherwise(F.concat(F.lit("."), t["f"]))))

    return F.when(_plain(s), F.when(s.rlike(_MINUS_ZERO), F.substr(s, F.lit(2), F.length(s))).otherwise(s)).when(s.rlike(_DECIMAL), _parts(s, expanded))

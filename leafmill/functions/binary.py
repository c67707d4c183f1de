"""Byte-level column functions: fixed-width integers, hexadecimal and base64 forms, content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.constants import TYPE_MAP_DOMAIN


def u32be(n: Column) -> Column:
    """Four bytes, most significant first; null outside 0 to 2^32 - 1."""
    n = n.cast("bigint")
    return F.when((n >= 0) & (n <= 2**32 - 1), F.unhex(F.lpad(F.hex(n), 8, "0")))


def u64be(n: Column) -> Column:
    """Eight bytes, most significant first; null for negative numbers."""
    n = n.cast("bigint")
    return F.when(n >= 0, F.unhex(F.lpad(F.hex(n), 16, "0")))


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    """Bytes of a lower-case hexadecimal string of even length; null for any other."""
    return F.when(s.rlike(r"\A(?:[0-9a-f]{2})*\z"), F.unhex(s))


def from_base64(s: Column) -> Column:
    """Bytes of canonical base64: standard alphabet, exact padding, zero pad bits, no white space; null for any other.

    Needs spark.sql.chunkBase64String.enabled=false, or long values would not survive the comparison.
    """
    shaped = s.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    b = F.when(shaped, F.try_to_binary(s, F.lit("base64")))
    return F.when(F.regexp_replace(F.base64(b), "[\r\n]", "") == s, b)


def content_id(b: Column) -> Column:
    """The id of a type map's exact bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(bytearray(TYPE_MAP_DOMAIN)), b), 256))

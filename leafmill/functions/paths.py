"""Paths: arrays of segments, each a key or an index."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.constants import MAX_INDEX, PATH_TYPE
from leafmill.functions.binary import u32be


def path(*segments: str | int | Column) -> Column:
    """A path of keys (text) and indices (numbers, or columns of whole numbers)."""
    items = []
    for s in segments:
        key, index = (F.lit(s), F.lit(None)) if isinstance(s, str) else (F.lit(None), F.lit(s) if isinstance(s, int) else s)
        items.append(F.struct(key.cast("string").alias("key"), index.cast("bigint").alias("index")))
    return F.array(*items).cast(PATH_TYPE)


def encode_path(p: Column) -> Column:
    """The canonical bytes of a path whose keys are in NFC: its identity and its place in path order. Null if an index
    is out of range."""
    key = lambda s: F.concat(F.lit(bytearray(b"\x01")), u32be(F.octet_length(s["key"])), F.encode(s["key"], "UTF-8"))
    index = lambda s: F.concat(F.lit(bytearray(b"\x02")), u32be(s["index"]))
    segment = lambda s: F.when(s["key"].isNotNull(), key(s)).otherwise(index(s))
    return F.concat(u32be(F.size(p)), F.aggregate(p, F.lit(bytearray(b"")), lambda a, s: F.concat(a, segment(s))))


def known_path(keys: Sequence[str]) -> Column:
    """The canonical bytes of a path of keys, as a constant."""
    parts = [unicodedata.normalize("NFC", k).encode() for k in keys]
    return F.lit(bytearray(len(parts).to_bytes(4, "big") + b"".join(b"\x01" + len(p).to_bytes(4, "big") + p for p in parts)))


def display_path(p: Column) -> Column:
    """a.b[0].c, for people; never hashed or parsed."""
    step = lambda a, s: F.when(s["key"].isNull(), F.concat(a, F.lit("["), s["index"].cast("string"), F.lit("]"))).when(a == "", s["key"]).otherwise(F.concat(a, F.lit("."), s["key"]))
    return F.aggregate(p, F.lit(""), step)


def shape(p: Column) -> Column:
    """The path with every index replaced by [*] and keys told apart from them, as one string to join on."""
    return F.array_join(F.transform(p, lambda s: F.when(s["key"].isNull(), F.lit("[*]")).otherwise(F.concat(F.lit("."), F.replace(F.replace(s["key"], F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/"))))), "/")


def index_in_range(p: Column) -> Column:
    return F.forall(p, lambda s: s["index"].isNull() | s["index"].between(0, MAX_INDEX))


def is_reserved(p: Column, prefix: str) -> Column:
    """Whether the first segment is a key in the reserved namespace. Only the first counts, in NFC."""
    return F.coalesce(F.get(p, F.lit(0))["key"].startswith(prefix), F.lit(False))

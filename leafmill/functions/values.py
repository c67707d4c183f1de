"""Values: what kinds of JSON fit a tag, their canonical bytes and their form in an envelope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.binary import from_base64, from_hex, to_hex, u32be, u64be
from leafmill.functions.numbers import canonical_decimal, canonical_integer, decimal_reason, integer_reason
from leafmill.functions.text import nfc


def carries_no_value(tag: Column) -> Column:
    return tag.isin(C.NULL, C.EMPTY_ARRAY, C.EMPTY_OBJECT)


def kind_of_tag(tag: Column) -> Column:
    """The JSON kind of a record's value under a tag."""
    out = F.lit(None).cast("string")
    for t, kind in C.TAG_KINDS.items():
        out = F.when(tag == t, F.lit(kind)).otherwise(out)
    return out


def value_reason(tag: Column, kind: Column, literal: Column) -> Column:
    """Why a record's value can't be committed under tag: a reason code, or null. literal: the text of a string, the
    digits of a number as written, true or false."""
    return (
        F.when(tag == C.BLOB_REF, F.lit("blob-ref-not-selectable"))
        .when(~tag.between(0, 8) | (kind != kind_of_tag(tag)), F.lit("value-type-mismatch"))
        .when(tag == C.INTEGER, integer_reason(literal))
        .when(tag == C.DECIMAL, decimal_reason(literal))
        .when((tag == C.BYTES) & from_base64(literal).isNull(), F.lit("base64-not-canonical"))
    )


def carrier(tag: Column, literal: Column, any_text: bool = True) -> Column:
    """The value's form in an envelope: canonical digits, NFC text, hexadecimal bytes; null for tags without value.
    any_text=False promises ASCII, and needs no Python."""
    return (
        F.when(tag == C.STRING, nfc(literal, any_text))
        .when(tag == C.INTEGER, canonical_integer(literal))
        .when(tag == C.DECIMAL, canonical_decimal(literal))
        .when(tag == C.BYTES, to_hex(from_base64(literal)))
        .when(tag == C.BOOL, literal)
    )


def carrier_reason(tag: Column, value: Column) -> Column:
    """Why an envelope's value doesn't fit its tag."""
    return (
        F.when(tag == C.BLOB_REF, F.lit("blob-ref-not-selectable"))
        .when(~tag.between(0, 8), F.lit("value-type-mismatch"))
        .when(carries_no_value(tag) & value.isNotNull(), F.lit("value-type-mismatch"))
        .when(~carries_no_value(tag) & value.isNull(), F.lit("disclosed-leaf-named-without-value"))
        .when((tag == C.BOOL) & ~value.isin("true", "false"), F.lit("value-type-mismatch"))
        .when(tag == C.INTEGER, integer_reason(value))
        .when(tag == C.DECIMAL, decimal_reason(value))
        .when((tag == C.BYTES) & from_hex(value).isNull(), F.lit("value-type-mismatch"))
    )


def encode_value(tag: Column, value: Column, normal: bool = False) -> Column:
    """The canonical bytes of an envelope's value. normal: text is in NFC and numbers are canonical already."""
    empty = F.lit(bytearray(b""))
    return (
        F.when(carries_no_value(tag), empty)
        .when(tag == C.BOOL, F.when(value == "true", F.lit(bytearray(b"\x01"))).otherwise(F.lit(bytearray(b"\x00"))))
        .when(tag == C.STRING, F.encode(value if normal else nfc(value), "UTF-8"))
        .when(tag == C.INTEGER, F.encode(value if normal else canonical_integer(value), "UTF-8"))
        .when(tag == C.DECIMAL, F.encode(value if normal else canonical_decimal(value), "UTF-8"))
        .when(tag == C.BYTES, from_hex(value))
    )


def blob_ref(length: Column, digest: Column) -> Column:
    """The bytes of a reference to a blob. No record or envelope may carry one; only the encoding exists."""
    return F.concat(u64be(length), u32be(F.octet_length(digest)), digest)

"""Known answers of the commitment format, and the rules no SQL oracle covers."""

import pytest
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import binary, merkle, numbers
from leafmill.functions.paths import encode_path
from leafmill.functions.text import nfc, unicode_versions
from leafmill.operators import giant, leaves, typing
from leafmill.sources import records
from leafmill.sources.type_maps import Automaton, PatternMap

# A known record, its salts by path, and its root.
RECORD = '{"counts": {"integer": 5, "decimal": 0.010, "text": "5"}, "flag": true, "marker": "typed"}'


def test_unicode_is_pinned(spark):
    assert all(r["pinned"] for r in unicode_versions(spark).collect())


@pytest.mark.parametrize(
    ("literal", "canonical"),
    [("0.010", "0.010"), ("1e2", "100"), ("1.0e2", "100"), ("1.00e1", "10.0"), ("1.5e-2", "0.015"), ("1e-3", "0.001"), ("0e5", "0"), ("-0.00", "0.00"), ("-0", "0"), ("100.0", "100.0"), ("1e1023", "1" + "0" * 1023)],
)
def test_decimals(spark, literal, canonical):
    assert spark.createDataFrame([(literal,)], "s string").select(numbers.canonical_decimal(F.col("s"))).first()[0] == canonical


@pytest.mark.parametrize(("literal", "reason"), [("1.4e+9999", "digit-bound-exceeded"), ("1e1024", "digit-bound-exceeded"), ("01", "decimal-grammar"), ("1.", "decimal-grammar"), (".5", "decimal-grammar"), ("+1", "decimal-grammar"), ("1.0\n", "decimal-grammar"), ("0x10", "decimal-grammar"), ("", "decimal-grammar")])
def test_decimal_reasons(spark, literal, reason):
    got = spark.createDataFrame([(literal,)], "s string").select(numbers.decimal_reason(F.col("s")), numbers.canonical_decimal(F.col("s"))).first()
    assert tuple(got) == (reason, None)


@pytest.mark.parametrize(
    ("text", "reason"),
    [('{"a":1,"a":2}', "duplicate-key"), ("[NaN]", "non-finite-number"), ('["\\ud800"]', "unpaired-surrogate"), ("[1] 2", "json-syntax"), ("[01]", "json-syntax"), (None, "json-syntax"), ("", "json-syntax"), ("[" * 2000 + "]" * 2000, "json-syntax")],
)
def test_records_are_refused(spark, text, reason):
    assert [r["reason"] for r in records.flatten(spark.createDataFrame([("r", text)], "record_id string, record_json string")).collect()] == [reason]


def test_flatten_keeps_literals_and_empty_containers(spark):
    text = '{"a":{},"b":[[],1e2,{"c":-0.0}],"d":9223372036854775808}'
    rows = records.flatten(spark.createDataFrame([("r", text), ("e", "{}")], "record_id string, record_json string")).orderBy("record_id", "position").collect()
    assert [(r["json_kind"], r["literal"]) for r in rows] == [("object", None), ("object", None), ("array", None), ("number", "1e2"), ("number", "-0.0"), ("number", "9223372036854775808")]
    assert rows[0]["path"] == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 9, 130])
def test_trees_and_proofs(spark, n):
    hashes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.unhex(F.sha2(i.cast("string"), 256)))
    t = spark.range(1).select(hashes.alias("h")).select("h", merkle.root(F.col("h")).alias("root"), merkle.levels(F.col("h")).alias("levels"))
    p = t.select("root", F.posexplode("h").alias("i", "leaf"), "levels").withColumn("path", merkle.audit_path(F.col("levels"), F.col("i")))
    check = lambda i, path: merkle.verify_inclusion(F.col("leaf"), i, F.lit(n), path, F.col("root"))
    got = p.select(check(F.col("i"), F.col("path")).alias("ok"), check((F.col("i") + 1) % n, F.col("path")).alias("moved"), check(F.col("i"), F.concat("path", F.array("leaf"))).alias("longer")).collect()
    assert all(r["ok"] for r in got) and not any(r["longer"] for r in got)
    assert n == 1 or not any(r["moved"] for r in got)


def test_giant_root_equals_small_root(spark, tmp_path):
    n = 2500
    rows = spark.range(n).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf_hash")).repartition(7)
    small = rows.agg(F.array_sort(F.collect_list(F.struct("id", "leaf_hash"))).alias("k")).select(binary.to_hex(merkle.root(F.transform("k", lambda x: x["leaf_hash"])))).first()[0]
    got = giant.table_root(rows, ["id"], str(tmp_path)).select("leaf_count", binary.to_hex(F.col("root")).alias("root")).first()
    assert (got["leaf_count"], got["root"]) == (n, small)
    assert giant.table_root(rows.limit(0), ["id"], str(tmp_path / "none")).first()["leaf_count"] == 0


def _identity(spark):
    return spark.createDataFrame([("r", "t", "1.0", None, "urn:i", None)], "record_id string, record_type string, schema_version string, type_map_id string, issuer_id string, issuer_key_id string")


def _typed(spark, text, entries):
    flat = records.flatten(spark.createDataFrame([("r", text)], "record_id string, record_json string"))
    return typing.by_patterns(flat, PatternMap(entries))


ENTRIES = [("counts.integer", "number", C.INTEGER), ("counts.decimal", "number", C.DECIMAL), ("counts.text", "string", C.STRING), ("flag", "boolean", C.BOOL), ("marker", "string", C.STRING)]


def _committed(spark, text, entries, drop=None, ordering="path"):
    typed, recs = _typed(spark, text, entries), _identity(spark)
    named = typed.select("record_id", "path").unionByName(leaves.reserved_leaves(recs, ordering).select("record_id", "path")).select("record_id", encode_path(leaves.normal_path(F.col("path"))).alias("encoded_path"))
    salts = named.withColumn("salt", F.unhex(F.substring(F.sha2("encoded_path", 256), 1, 32)))
    salts = salts.filter(~F.contains(F.decode("encoded_path", "ISO-8859-1"), F.lit(drop))) if drop else salts
    return leaves.commit(recs, typed, salts, ordering)[1].first()


def test_commit(spark):
    got = _committed(spark, RECORD, ENTRIES)
    assert got["leaf_count"] == 9 and got["reason"] is None and got["root"] is not None
    assert _committed(spark, RECORD, ENTRIES, ordering="hash")["root"] != got["root"]
    assert _committed(spark, RECORD.replace("0.010", "0.01"), ENTRIES)["root"] != got["root"]


@pytest.mark.parametrize(
    ("text", "entries", "drop", "reason"),
    [
        (RECORD, ENTRIES[1:], None, "type-map-fail-closed"),
        (RECORD, ENTRIES, "marker", "salt-missing-for-leaf"),
        ('{"%s":"x"}' % C.RECORD_ID, [("**", "string", C.STRING)], None, "reserved-namespace"),
        ('{"flag":"x"}', [("flag", None, C.BOOL)], None, "value-type-mismatch"),
        ('{"b":"AA"}', [("b", "string", C.BYTES)], None, "base64-not-canonical"),
    ],
)
def test_commit_refuses(spark, text, entries, drop, reason):
    got = _committed(spark, text, entries, drop)
    assert (got["reason"], got["root"]) == (reason, None)


def test_decomposed_keys_and_values_commit_alike(spark):
    a, b = (_committed(spark, t, [("é", "string", C.STRING)]) for t in ('{"é":"ö"}', '{"e\\u0301":"o\\u0308"}'))
    assert a["root"] == b["root"]


def test_type_maps_are_checked():
    for bad in ([("a", "string", C.BLOB_REF)], [("a.**.b", "string", C.STRING)]):
        with pytest.raises(ValueError, match="type-map-rejected"):
            PatternMap(bad)
    with pytest.raises(ValueError, match="type-map-rejected"):
        Automaton(0, {}, {}, {(0, "string"): C.INTEGER})
    for args in (("sorted",), ("path", "SHA-1")):
        with pytest.raises(ValueError):
            merkle.domain(*args)


def test_salts_are_drawn_once(spark, tmp_path):
    rows = spark.range(50).select(F.lit("r").alias("record_id"), F.encode(F.col("id").cast("string"), "UTF-8").alias("encoded_path"))
    salts = leaves.draw_salts(rows, str(tmp_path / "salts"))
    assert salts.join(salts.withColumnRenamed("salt", "again"), ["record_id", "encoded_path"]).filter("salt = again and octet_length(salt) = 16").count() == 50
    assert salts.select("salt").distinct().count() == 50
    assert leaves.duplicate_paths(rows.union(rows)).count() == 50


def test_nfc(spark):
    got = spark.createDataFrame([("é",), ("abc",), (None,)], "s string").select(nfc(F.col("s"))).collect()
    assert [r[0] for r in got] == ["é", "abc", None]

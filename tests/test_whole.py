"""Records and envelopes held whole: the same rules as the column functions', and plans that shuffle nothing."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import merkle, numbers, values, whole
from leafmill.functions.paths import display_path
from leafmill.operators import issue, leaves, typing, verify
from leafmill.plans import issuing, queries as plans
from leafmill.sources import envelopes
from leafmill.sources.type_maps import Automaton, PatternMap

LITERALS = ["0", "-0", "01", "1.50", "-0.00", "1e2", "1.5e-2", "1.00e1", "-1E+0003", "1e1023", "1e1024", "0e5", "1e99999999", ".5", "1.", "+1", "", "é", "AA==", "AB==", "AAA", "YQ==\n", "0a", "0A", "true", "False", "9" * 1025, "1\n", "١"]


def test_values_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(t, k, s) for t in range(-1, 10) for k in ("number", "string", "boolean") for s in LITERALS] + [(t, k, None) for t in range(9) for k in ("null", "array", "object")], "tag int, kind string, s string")
    tag, s = F.col("tag"), F.col("s")
    why, other = values.value_reason(tag, F.col("kind"), s), values.carrier_reason(tag, s)
    text = F.when(why.isNull(), values.carrier(tag, s))
    got = rows.select("*", why.alias("why"), text.alias("text"), F.when(why.isNull(), values.encode_value(tag, text)).alias("data"), other.alias("other"), F.when(other.isNull(), values.encode_value(tag, s)).alias("shown")).collect()
    for r in got:
        assert whole.record_value(r["tag"], r["kind"], r["s"]) == (r["text"], r["data"], r["why"]), r
        assert whole.envelope_value(r["tag"], r["s"]) == (r["shown"], r["other"]), r
    assert numbers.MAX_DIGITS == C.MAX_DIGITS


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 13])
def test_trees_are_those_of_the_columns(spark, n):
    hashes = [whole.sha256(bytes([i])).digest() for i in range(n)]
    all_ = whole.levels(hashes)
    row = spark.createDataFrame([(hashes,)], "h array<binary>")
    assert row.select(merkle.root(F.col("h"))).first()[0] == all_[-1][0]
    paths = [whole.audit_path(all_, i) for i in range(n)]
    assert [r[0] for r in row.select(F.posexplode("h").alias("i", "_"), merkle.levels(F.col("h")).alias("l")).select(merkle.audit_path(F.col("l"), F.col("i"))).collect()] == paths
    cases = [(hashes[i], j, m, p, all_[-1][0]) for i in range(n) for j in range(n + 1) for m in (n, n + 1) for p in (paths[i], [*paths[i], hashes[0]], paths[i][:-1])]
    df = spark.createDataFrame([(*c, whole.proven(*c)) for c in cases], "leaf binary, i long, n long, p array<binary>, root binary, mine boolean")
    assert df.filter(merkle.verify_inclusion(F.col("leaf"), F.col("i"), F.col("n"), F.col("p"), F.col("root")) != F.col("mine")).count() == 0


def test_tags_are_those_of_the_columns(spark):
    maps = [
        PatternMap([("a[*].b", "number", C.INTEGER), ("a.**", None, C.STRING), ("a[*].b", None, C.DECIMAL), ("é", "string", C.BYTES), ("x/y", "string", C.STRING)]),
        PatternMap([("**", "string", C.STRING), ("a", "number", C.DECIMAL)]),
        Automaton(0, {(0, "a"): 1, (2, "b"): 3, (0, "x/y"): 3}, {1: 2}, {(3, "number"): C.INTEGER, (3, "string"): C.STRING}),
    ]
    paths = [(), ("a",), ("a", 0), ("a", 7, "b"), ("a", "b"), ("é",), ("é",), ("x/y",), ("x", "y"), ("z",)]
    rows = spark.createDataFrame([([(s, None) if isinstance(s, str) else (None, s) for s in p], k, i) for i, p in enumerate(paths) for k in ("number", "string")], f"path {C.PATH_TYPE}, json_kind string, i int")
    for m in maps:
        one = typing.tag_of(m)
        for r in typing.bind(rows, m).collect():
            assert one(paths[r["i"]], r["json_kind"], {}) == r["tag"], (m, r)
    exact = typing.tag_of({("t", "1", None): maps[0], ("t", "1", "m"): maps[1]})
    row = {"record_type": "t", "schema_version": "1"}
    assert exact(("a",), "number", row) is None and exact(("a",), "number", row | {"type_map_id": "m"}) == C.DECIMAL and exact(("a",), "number", row | {"type_map_id": "n"}) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_copies_are_verified_where_they_are_read(spark, data):
    """No leaf or envelope is dealt out again, and each envelope is read once."""
    copies = spark.createDataFrame([("e", "{}")], "envelope_id string, envelope_json string")
    plan = _plan(verify.verify(copies, config=issuing._CONFIG))
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert _plan(issuing.verify_full_copies(spark, data)).count("MapInArrow") == 2


def test_odd_envelopes_are_refused_and_not_fatal(spark):
    odd = [None, "", "[]", '{"canon":"\\ud800"}', "{" * 5000, '{"record":{"a":"\\ud800"},"salts":[]}']
    copies = spark.createDataFrame([(str(i), x) for i, x in enumerate(odd)] + [(None, "{}")], "envelope_id string, envelope_json string")
    rows = verify.verify(copies).collect()
    assert len(rows) == 7 and all(r["reason"] and not r["accepted"] and r["undischarged"] is None for r in rows)
    head = '{"canon":"ROAX-CANON/1","hashAlg":"SHA-256","recordType":"a.b","schemaVersion":"1","recordId":"r","root":"%s","leafCount":5,"issuer":{"id":"urn:a"},"record":{"a":1},"salts":[{"segments":[{"key":"%s"}],"salt":"%s"}]}' % ("0" * 64, "\\ud800", "0" * 32)
    assert verify.verify(spark.createDataFrame([("s", head)], "envelope_id string, envelope_json string"), {"a.b": []}).first()["reason"] == "unpaired-surrogate"


def test_copies_of_one_id_are_verified_each(spark):
    """Two envelopes under one id don't mix: a broken copy beside a whole one is refused, and only it."""
    made = issue.issue_records(_record(spark), issuing._CONFIG).first()["envelope_json"]
    both = spark.createDataFrame([("e", made), ("e", made.replace('"k":1', '"k":2'))], "envelope_id string, envelope_json string")
    assert sorted(str(r["reason"]) for r in verify.verify(both, config=issuing._CONFIG).collect()) == ["None", "root-mismatch"]


def _record(spark, **changes):
    row = {"record_id": "r", "record_json": '{"k":1,"p":"x","t":2.50}', "record_type": "test.order", "schema_version": "1.0", "type_map_id": issuing._MAP_ID, "type_map_version": "1.0.0", "issuer_id": "urn:x", "issuer_key_id": None} | changes
    named = ["k", "p", "t", C.RECORD_TYPE, C.SCHEMA_VERSION, C.TYPE_MAP_ID, C.RECORD_ID, C.ISSUER_ID]
    row["salts"] = changes.get("salts", [(whole.encode_path((x,)), bytes(15) + bytes([i])) for i, x in enumerate(named)])
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in list(row)[:-1]) + ", salts array<struct<encoded_path:binary,salt:binary>>")


@pytest.mark.parametrize(
    ("changes", "reason"),
    [({}, None), ({"type_map_id": None}, "envelope-malformed"), ({"type_map_version": None}, "envelope-malformed"), ({"record_json": None}, "json-syntax"), ({"record_json": '{"k":1,"k":1}'}, "duplicate-key"), ({"record_json": '{"z":1}'}, "type-map-fail-closed"), ({"record_json": '{"roax.a":1}'}, "reserved-namespace"), ({"salts": None}, "salt-missing-for-leaf"), ({"salts": []}, "salt-missing-for-leaf")],
)
def test_issuing_refuses(spark, changes, reason):
    row = issue.issue_records(_record(spark, **changes), issuing._CONFIG).first()
    assert row["reason"] == reason and (row["envelope_json"] is None) == (reason is not None)


def test_copies_are_downgraded_where_they_are_read(spark, data):
    """Issued, downgraded and verified in one pass: three readers, no leaf dealt out, nothing stored."""
    plan = _plan(issuing.downgrade_copies(spark, data))
    assert plan.count("MapInArrow") == 3 and "hashpartitioning" not in plan and "plans-" not in plan


def test_downgrading_refuses(spark):
    made = issue.issue_records(_record(spark), issuing._CONFIG).first()["envelope_json"]
    always = [whole.encode_path((x,)) for x in ("p", C.RECORD_TYPE, C.SCHEMA_VERSION, C.TYPE_MAP_ID, C.RECORD_ID, C.ISSUER_ID)]
    shown = issue.downgraded(spark.createDataFrame([("e", made, always)], "envelope_id string, envelope_json string, reveal array<binary>"), issuing._CONFIG).first()
    assert shown["reason"] is None
    cases = [(made, None, "minimum-disclosure-floor"), (made, always[1:], "minimum-disclosure-floor"), (made, [*always, b"x"], "envelope-malformed"), (made.replace('"k":1', '"k":2'), always, "root-mismatch"), (made.replace('"k":1', '"k":"1"'), always, "type-map-fail-closed"), (shown["envelope_json"], always, "envelope-copy-kind"), (made.replace("test.order", "test.other"), always, "profile-unknown"), (None, always, "envelope-malformed")]
    rows = spark.createDataFrame([(str(i), e, r) for i, (e, r, _) in enumerate(cases)], "envelope_id string, envelope_json string, reveal array<binary>")
    assert [r["reason"] for r in issue.downgraded(rows, issuing._CONFIG).orderBy("record_id").collect()] == [w for _, _, w in cases]


def test_tables_are_disclosed_where_their_rows_meet(spark, data):
    """Cells and envelopes aren't dealt out: two exchanges, of lines and of orders, and nothing is stored."""
    plan = _plan(plans.verify_envelopes(spark, data))
    assert plan.count("MapInArrow") == 2 and "plans-" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_tables_are_disclosed_as_leaf_by_leaf(spark, data):
    """The same copies as from single leaves, and an order without lines is refused unless it is asked for."""
    recs, cells = plans.order_records(spark, data), plans.order_cells(spark, data)
    both = cells.withColumn("reserved", F.lit(False)).unionByName(leaves.reserved_leaves(recs).withColumn("reserved", F.lit(True)))
    rows = leaves.hashed(leaves.encoded(both, ascii_only=True).withColumn("salt", plans._salt(F.col("record_id"), display_path(F.col("path")))))
    asked = rows.filter(F.col("reserved") | display_path(F.col("path")).endswith("l_partkey")).select("record_id", "encoded_path")
    shown, _, _ = leaves.disclose(rows, asked, rows.limit(0).select("record_id", "encoded_path"))
    old = {r["record_id"]: json.loads(r["envelope_json"]) for r in envelopes.write_disclosed(shown, recs).collect()}
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    by_order = plans._lines(spark, data).groupBy(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("record_id")).agg(F.sort_array(F.collect_list(line)).alias("rows"))
    made = lambda bare: issue.disclose_tables(recs.join(by_order, "record_id", "left"), "lines", plans._CELLS, lambda path: path[-1] == "l_partkey", salts=plans._test_salt, even_bare=bare)
    assert {r["record_id"]: json.loads(r["envelope_json"]) for r in made(True).collect()} == old
    refused = {r["record_id"] for r in made(False).collect() if r["reason"] == "record-contributes-no-leaves"}
    assert refused == {k for k, x in old.items() if x["leafCount"] < 6 and len(x["disclosure"]["leaves"]) == x["leafCount"]} and refused

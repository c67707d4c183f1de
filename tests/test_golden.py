"""Fixed values of the format: envelopes with their verdicts, records and salt sets (tests/golden, values as published)."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.operators import issue, leaves, verify
from leafmill.operators.typing import by_patterns
from leafmill.sources import envelopes, records
from leafmill.sources.records import parse
from leafmill.sources.type_maps import PatternMap

GOLDEN = Path(__file__).parent / "golden"


def _lines(name):
    return [json.loads(x) for x in (GOLDEN / f"{name}.jsonl").read_text().splitlines()]


@pytest.fixture(scope="module")
def type_map():
    return PatternMap.from_text((GOLDEN / "type_map.json").read_text())


@pytest.fixture(scope="module")
def config(type_map):
    return verify.Verifier(profiles=C.PROFILE_FLOORS | {type_map.record_type: [["marker"]]}, maps=type_map)


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame([(x["name"], x["envelope"]) for x in _lines("envelopes")], "envelope_id string, envelope_json string").cache()


def test_verdicts(copies, config):
    rows = {r["envelope_id"]: r for r in verify.verify(copies, config=config).collect()}
    open_ = {k: r["undischarged"] for k, r in rows.items()}
    assert "type-map-not-bound" in open_["floor-hl7-fhir-bundle-complete"] and "type-map-not-bound" not in open_["typemap-floor-hl7-fhir-bundle-complete"]
    assert "type-map-not-checked" not in open_["full-copy-complete-salts"] and open_["profile-unknown-fails-closed"] is None
    got = {k: r["reason"] for k, r in rows.items()}
    assert got == {x["name"]: x["reason"] for x in _lines("envelopes")} and len(got) == 69


def test_policies(copies, config, spark):
    """What only the verifier knows: registered roots and algorithms, a registry and its chain, an exact map."""
    name = "full-copy-complete-salts"
    one = copies.filter(F.col("envelope_id") == name)
    doc = json.loads(next(x["envelope"] for x in _lines("envelopes") if x["name"] == name))
    root = bytes.fromhex(doc["root"])

    def reason(rows=one, **changes):
        return verify.verify(rows, config=verify.Verifier(**{**vars(config), **changes})).first()["reason"]

    anchored = lambda *row: spark.createDataFrame([(name, *row)], "envelope_id string, root binary, hash_alg string")
    assert reason(anchored=anchored(root, "SHA-256")) is None
    assert reason(anchored=anchored(root[::-1], "SHA-256")) == "root-mismatch"
    assert reason(anchored=anchored(root, "other")) == "hash-alg-not-allowed"
    assert reason(need_type_map=True) == "outer-identity-mismatch"
    assert reason(algorithms=()) == "hash-alg-not-allowed"
    assert reason(maps=None) == "type-map-fail-closed"
    assert reason(ordering="hash") == "salt-missing-for-leaf"  # that of the ordering
    address = "0x" + "ab" * 20
    routed = one.withColumn("envelope_json", F.replace("envelope_json", F.lit('"issuer":'), F.lit(f'"anchor":{{"chainId":5,"registry":"{address}"}},"issuer":')))
    assert reason(routed) is None and reason(routed, registry=address, chain_id=5) is None
    assert reason(routed, registry="0x" + "cd" * 20) == reason(routed, chain_id=6) == "envelope-malformed"
    bad = routed.withColumn("envelope_json", F.replace("envelope_json", F.lit('"chainId":5'), F.lit('"chainId":5,"anchoredAt":"2023-02-29T00:00:00Z"')))
    assert reason(bad) == "envelope-malformed"
    for old, new in (('"leafCount":9', '"leafCount":4'), (doc["issuer"]["id"], "no uri"), (doc["recordType"], "Upper.case")):
        assert reason(one.withColumn("envelope_json", F.replace("envelope_json", F.lit(old), F.lit(new)))) == "envelope-malformed"


def test_salt_sets(spark):
    sets = spark.createDataFrame([(x["name"], x["salts"]) for x in _lines("salts")] + [("bad", '{"pairing":"path","salts":[{"segments":[],"salt":"00"}]}'), ("twice", json.dumps({"pairing": "path", "salts": [{"segments": [], "salt": "0" * 32}] * 2})), ("short", '{"pairing":"positional","leafCount":2,"salts":[]}'), ("none", None)], "set_id string, salts_json string")
    by_path, by_place, refused = envelopes.read_salt_sets(sets)
    n = {x["name"]: (json.loads(x["salts"])["pairing"], len(json.loads(x["salts"])["salts"])) for x in _lines("salts")}
    assert len(n) == 37
    for df, pairing in ((by_path, "path"), (by_place, "positional")):
        assert {r["record_id"]: r["n"] for r in df.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: c for k, (p, c) in n.items() if p == pairing}
    assert {r["set_id"]: r["reason"] for r in refused.collect()} == {"bad": "envelope-malformed", "twice": "salts-duplicate-path", "short": "salts-length-not-leaf-count", "none": "envelope-malformed"}
    # No salt serves two leaves, in these sets or across them.
    drawn = by_path.select(F.col("record_id").alias("issuance"), "record_id", F.to_json("path").alias("encoded_path"), "salt")
    assert issue.shared_salts(drawn).count() == 0
    again = drawn.withColumn("issuance", F.concat("issuance", F.lit("+")))
    assert issue.shared_salts(drawn.union(again)).filter("issuances = 2 and times = 2").count() == drawn.count()


ROUND_TRIPS = {"roundtrip-every-carrier-form": True, "roundtrip-without-issuer-key-id": False}


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_issue_then_disclose(spark, config, type_map, name, tmp_path):
    """A record under a set of salts gives the published full copy, and that the published disclosed one."""
    by_name = {x["name"]: x["envelope"] for x in _lines("envelopes")}
    want, shown = json.loads(by_name[f"{name}-full"]), json.loads(by_name[f"{name}-disclosed"])
    text = next(x["record"] for x in _lines("records") if x["name"] == "roundtrip-carriers")
    salts = next(x["salts"] for x in _lines("salts") if x["name"] == name)
    map_id = want.get("typeMap", {}).get("id")
    head = [("r", text, want["recordId"], want["recordType"], want["schemaVersion"], map_id, want.get("typeMap", {}).get("version"), want["issuer"]["id"], want["issuer"].get("keyId"))]
    recs = spark.createDataFrame(head, "record_id string, record_json string, identity_id string, record_type string, schema_version string, type_map_id string, type_map_version string, issuer_id string, issuer_key_id string")
    own = records.flatten(recs.select("record_id", "record_json"))
    empty = F.when(F.col("json_kind") == "null", 0).when(F.col("json_kind") == "array", 6).when(F.col("json_kind") == "object", 7)
    typed = by_patterns(own, type_map).withColumn("tag", F.coalesce(empty, F.col("tag")))
    by_path, _, _ = envelopes.read_salt_sets(spark.createDataFrame([("r", salts)], "set_id string, salts_json string"))
    keyed = by_path.withColumn("encoded_path", leaves.encode_path(leaves.normal_path(F.col("path"))))
    rows, roots = leaves.commit(recs, typed, keyed, identity_id="identity_id")
    made = envelopes.write_full(rows, roots, recs).first()["envelope_json"]
    got = json.loads(made)
    key = lambda x: json.dumps(x["segments"])
    assert {k: v for k, v in got.items() if k not in ("salts", "record")} == {k: v for k, v in want.items() if k not in ("salts", "record")}
    assert sorted(got["salts"], key=key) == sorted(want["salts"], key=key)
    assert parse(made)["record"] == parse(text) == parse(by_name[f"{name}-full"])["record"]

    full = spark.createDataFrame([("e", made)], "envelope_id string, envelope_json string")
    asked = spark.createDataFrame([("e", [{"key": s.get("key"), "index": s.get("index")} for s in x["segments"]]) for x in shown["disclosure"]["leaves"]], f"record_id string, path {C.PATH_TYPE}")
    reveal = asked.select("record_id", leaves.encode_path(leaves.normal_path(F.col("path"))).alias("encoded_path"))
    # Without what the profile must show, or with a leaf that isn't there, nothing is made.
    less = reveal.filter(F.col("encoded_path") != leaves.encode_path(leaves.path(C.RECORD_ID)))
    more = reveal.union(spark.range(1).select(F.lit("e"), leaves.encode_path(leaves.path("no such"))))
    all_three = full.withColumn("envelope_id", F.explode(F.array(*map(F.lit, ("e", "less", "more", "broken")))))
    all_three = all_three.withColumn("envelope_json", F.when(F.col("envelope_id") == "broken", F.replace("envelope_json", F.lit(want["root"]), F.lit("0" * 64))).otherwise(F.col("envelope_json")))
    asked = reveal.union(less.withColumn("record_id", F.lit("less"))).union(more.withColumn("record_id", F.lit("more")))
    copies, refused = issue.downgrade(all_three, asked, config, str(tmp_path / "work"))
    (made,) = copies.collect()
    out = json.loads(made["envelope_json"])
    plain = lambda d: sorted(({k: v for k, v in x.items() if k != "displayPath"} for x in d["disclosure"]["leaves"]), key=key)
    assert plain(out) == plain(shown) and {k: v for k, v in out.items() if k != "disclosure"} == {k: v for k, v in shown.items() if k != "disclosure"}
    assert {r["record_id"]: r["reason"] for r in refused.collect()} == {"less": "minimum-disclosure-floor", "more": "envelope-malformed", "broken": "root-mismatch"}


def test_issue_needs_an_exact_map(spark):
    head = [("a", "{}", "t.x", "1", None, "1.0.0", "urn:a", None), ("b", "{}", "t.x", "1", "sha256:" + "0" * 64, None, "urn:a", None)]
    recs = spark.createDataFrame(head, "record_id string, record_json string, record_type string, schema_version string, type_map_id string, type_map_version string, issuer_id string, issuer_key_id string")
    typed = spark.createDataFrame([], f"record_id string, path {C.PATH_TYPE}, tag int, json_kind string, literal string")
    salts = spark.createDataFrame([], "record_id string, encoded_path binary, salt binary")
    made, refused = issue.issue_full(recs, typed, salts)
    assert made.count() == 0 and {r["record_id"]: r["reason"] for r in refused.collect()} == {"a": "envelope-malformed", "b": "envelope-malformed"}


def test_empty_containers_by_the_map(spark, copies, config):
    name = "full-copy-complete-salts"
    strict = verify.Verifier(**{**vars(config), "empty_containers": "map-authorized"})
    assert verify.verify(copies.filter(F.col("envelope_id") == name), config=strict).first()["reason"] is None
    recs = [x for x in _lines("records") if x["name"].startswith("structure-empty")]
    own = records.flatten(spark.createDataFrame([(x["name"], x["record"]) for x in recs], "record_id string, record_json string"))
    bound = by_patterns(own, config.maps)
    assert bound.filter(F.col("json_kind").isin("array", "object") & F.col("tag").isNotNull()).count() == 0
    extra = PatternMap([*config.maps.entries, ("a.b", "array", C.EMPTY_ARRAY), ("a.b", "object", C.EMPTY_OBJECT)])
    assert {r["tag"] for r in by_patterns(own, extra).filter(F.col("json_kind").isin("array", "object")).collect()} == {C.EMPTY_ARRAY, C.EMPTY_OBJECT}

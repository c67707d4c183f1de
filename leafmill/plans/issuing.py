"""Queries over the test tables for issuing, verifying with policies, exact maps and artifacts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import binary, identifiers
from leafmill.functions.paths import display_path, encode_path, known_path, path
from leafmill.operators import issue, leaves, typing, verify
from leafmill.plans.queries import _hash_sql, _key_sql, _levels_sql, _salt, _spread, _t, query
from leafmill.sources import artifacts, envelopes, records
from leafmill.sources.type_maps import PatternMap

_CANDIDATES = {
    "record_type": ("'a.b' || o_orderkey", "'A.b'", "'a'", "'a-.b'"),
    "content_id": ("'sha256:' || sha256(o_orderkey::varchar)", "'sha256:' || o_orderkey"),
    "version": ("o_orderkey || '.0.1'", "'1.0'"),
    "registry": ("'0x' || substr(sha256(o_orderkey::varchar), 1, 40)", "'0X00'"),
}


@query(" union all ".join(f"select o_orderkey, '{kind}' as kind, s, regexp_full_match(s, '{identifiers.PATTERNS[kind]}') as fits from (select o_orderkey, unnest([{', '.join(c)}]) as s from orders)" for kind, c in _CANDIDATES.items()))
def identifier_grammars(spark, d):
    k = F.col("o_orderkey").cast("string")
    digest = F.sha2(k, 256)
    made = {
        "record_type": [F.concat(F.lit("a.b"), k), F.lit("A.b"), F.lit("a"), F.lit("a-.b")],
        "content_id": [F.concat(F.lit("sha256:"), digest), F.concat(F.lit("sha256:"), k)],
        "version": [F.concat(k, F.lit(".0.1")), F.lit("1.0")],
        "registry": [F.concat(F.lit("0x"), F.substring(digest, 1, 40)), F.lit("0X00")],
    }
    rows = _t(spark, d, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), s.alias("s")) for kind, many in made.items() for s in many])).alias("c")).select("o_orderkey", "c.kind", "c.s")
    fits = F.lit(None).cast("boolean")
    for kind in made:
        fits = F.when(F.col("kind") == kind, identifiers.is_a(kind, F.col("s"))).otherwise(fits)
    return rows.withColumn("fits", fits)


@query("select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey::varchar end as literal, case when o_orderkey % 3 = 0 then 'json-syntax' end as reason from orders")
def utf8_strict(spark, d):
    """Records as bytes; a third of them isn't UTF-8."""
    k = F.col("o_orderkey")
    data = F.concat(F.encode(F.concat(F.lit('{"a":'), k.cast("string"), F.lit(',"b":"')), "UTF-8"), F.when(k % 3 == 0, F.lit(bytearray(b"\xc3"))).otherwise(F.lit(bytearray(b"\xc3\xa9"))), F.lit(bytearray(b'"}')))
    rows = records.flatten(_spread(_t(spark, d, "orders")).select(k.alias("record_id"), data.alias("record_json")))
    return rows.filter("position = 0").select(F.col("record_id").cast("long").alias("o_orderkey"), "literal", "reason")


@query("""select event_id, case when event_id % 4 = 0 then null else '{"n":' || event_id || '.10,"e":-0E+2,"s":"' || event_type || '\\t\\u0001é","l":[1,[],{}],"p":{"k":null,"t":true}}' end as record_json, case when event_id % 4 = 0 then 'duplicate-key' end as reason from events""")
def json_rewrite(spark, d):
    """Space goes, literals and the order of members stay."""
    e = F.col("event_id")
    more = F.when(e % 4 == 0, F.lit(', "n": 1')).otherwise(F.lit(""))
    text = F.concat(F.lit('{ "n" : '), e.cast("string"), F.lit('.10 ,"e":-0E+2,\n"s":"'), F.col("event_type"), F.lit('\\u0009\\u0001\\u00e9", "l":[1, [ ],{ }], "p":{"k":null,"t":true}'), more, F.lit(" }"))
    rows = records.rewritten(_spread(_t(spark, d, "events")).select(e.alias("record_id"), text.alias("record_json")))
    return rows.select(F.col("record_id").cast("long").alias("event_id"), "record_json", "reason")


# ---- full copies of orders

_MAP_ID = "sha256:" + "5" * 64
_MAP = PatternMap([("k", "number", C.INTEGER), ("p", "string", C.STRING), ("t", "number", C.DECIMAL)], "test.order", "1.0", _MAP_ID)
_MAPS = {("test.order", "1.0", _MAP_ID): _MAP}
_CONFIG = verify.Verifier(profiles={"test.order": [["p"]]}, maps=_MAPS)


def _records(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    text = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"p":"'), F.col("o_orderpriority"), F.lit('","t":'), F.col("o_custkey").cast("string"), F.lit(".50}"))
    return _spread(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")).select(F.concat(F.lit("order-"), k.cast("string")).alias("record_id"), text.alias("record_json"), F.lit("test.order").alias("record_type"), F.lit("1.0").alias("schema_version"), F.when(k % 11 != 0, F.lit(_MAP_ID)).alias("type_map_id"), F.lit("1.0.0").alias("type_map_version"), F.lit("urn:x").alias("issuer_id"), none.alias("issuer_key_id"))


def _issued(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = ["k", "p", "t", C.RECORD_TYPE, C.SCHEMA_VERSION, C.TYPE_MAP_ID, C.RECORD_ID, C.ISSUER_ID]
    salts = F.array(*[F.struct(known_path([key]).alias("encoded_path"), _salt(F.col("record_id"), F.lit(key)).alias("salt")) for key in named])
    made = issue.issue_records(_records(spark, d).withColumn("salts", salts), _CONFIG)
    return made.filter("reason is null").select("record_id", "envelope_json"), made.filter("reason is not null").select("record_id", "reason")


def _leaf_sql(key: str, tag: int, value: str) -> str:
    return f"select 'order-' || o_orderkey as record_id, '{key}' as display, '00000001{_key_sql(key)}' as p, {tag} as tag, {value} as v from o"


_SQL_FULL = "o as (select * from orders where o_orderkey % 11 <> 0), own as (" + " union all ".join(
    [_leaf_sql("k", 3, "o_orderkey::varchar"), _leaf_sql("p", 2, "o_orderpriority"), _leaf_sql("t", 4, "o_custkey || '.50'"), _leaf_sql(C.RECORD_TYPE, 2, "'test.order'"), _leaf_sql(C.SCHEMA_VERSION, 2, "'1.0'"), _leaf_sql(C.TYPE_MAP_ID, 2, f"'{_MAP_ID}'"), _leaf_sql(C.RECORD_ID, 2, "'order-' || o_orderkey"), _leaf_sql(C.ISSUER_ID, 2, "'urn:x'")]
) + ")"


@query(f"with recursive {_SQL_FULL}, hashes as {_hash_sql('own')}, {_levels_sql('hashes')} select 'order-' || o_orderkey as record_id, h as root, case when h is not null then 8 else -1 end as salts, case when h is not null then '{{\"k\":' || o_orderkey || ',\"p\":\"' || o_orderpriority || '\",\"t\":' || o_custkey || '.50}}' end as record_json, case when h is null then 'envelope-malformed' end as reason from orders left join levels on record_id = 'order-' || o_orderkey and n = 1")
def issue_full_copies(spark, d):
    """Roots, salts and the record as written, read back from the copies; what isn't bound to a map isn't issued."""
    copies, refused = _issued(spark, d)
    read = envelopes.read_envelopes(copies.withColumnRenamed("record_id", "envelope_id"))
    made = read.select(F.col("record_id"), binary.to_hex(F.col("root")).alias("root"), F.size("salts").alias("salts"), "record_json", "reason")
    return made.unionByName(refused, allowMissingColumns=True).withColumn("salts", F.coalesce("salts", F.lit(-1)))


@query("""select 'order-' || o_orderkey as envelope_id, o_orderkey % 7 in (5, 6) as accepted, case o_orderkey % 7 when 0 then 'root-mismatch' when 1 then 'salts-length-not-leaf-count' when 2 then 'envelope-copy-kind' when 3 then 'type-map-fail-closed' when 4 then 'leaf-count-mismatch' end as reason from orders where o_orderkey % 11 <> 0""")
def verify_full_copies(spark, d):
    """Copies with a changed value, a wrong count, no record, a string where the map has a number, and salts too many; the rest is whole."""
    copies, _ = _issued(spark, d)
    k, text = F.substring_index("record_id", "-", -1).cast("long") % 7, F.col("envelope_json")
    extra = F.lit(f'"salts":[{{"segments":[{{"key":"zz"}}],"salt":"{"0" * 32}"}},')
    changed = (
        F.when(k == 0, F.replace(text, F.lit('.50}'), F.lit('.51}')))
        .when(k == 1, F.replace(text, F.lit('"leafCount":8'), F.lit('"leafCount":9')))
        .when(k == 2, F.regexp_replace(text, r'"record":\{[^}]*\},', ""))
        .when(k == 3, F.regexp_replace(text, r'"k":([0-9]+)', '"k":"$1"'))
        .when(k == 4, F.replace(F.replace(text, F.lit('"leafCount":8'), F.lit('"leafCount":9')), F.lit('"salts":['), extra))
        .otherwise(text)
    )
    return verify.verify(copies.select(F.col("record_id").alias("envelope_id"), changed.alias("envelope_json")), config=_CONFIG).drop("undischarged")


@query("""select 'order-' || o_orderkey as record_id, o_orderkey % 3 = 0 as accepted, case o_orderkey % 3 when 1 then 'minimum-disclosure-floor' when 2 then 'envelope-malformed' end as reason from orders where o_orderkey % 11 <> 0""")
def downgrade_copies(spark, d):
    """Full copies to disclosed ones that verify; a third leaves out what the profile must show, a third asks for a leaf that isn't there."""
    copies, _ = _issued(spark, d)
    k = F.substring_index("record_id", "-", -1).cast("long") % 3
    always = [known_path([x]) for x in (C.RECORD_TYPE, C.SCHEMA_VERSION, C.TYPE_MAP_ID, C.RECORD_ID, C.ISSUER_ID)]
    asked = lambda *keys: F.array(*always, *[known_path([x]) for x in keys])
    reveal = F.when(k == 0, asked("p", "k")).when(k == 1, asked("k")).otherwise(asked("p", "q"))
    made = issue.downgraded(copies.select(F.col("record_id").alias("envelope_id"), "envelope_json", reveal.alias("reveal")), _CONFIG)
    checked = verify.verify(made.select(F.col("record_id").alias("envelope_id"), "envelope_json", F.col("reason").alias("refused")), config=_CONFIG, keep=["refused"])
    return checked.select(F.col("envelope_id").alias("record_id"), "accepted", F.coalesce("refused", "reason").alias("reason"))


# ---- maps

_SCHEMA = {
    "order.json": {"type": "object", "required": ["n"], "properties": {"n": {"$ref": "types.json#/definitions/whole"}, "s": {"anyOf": [{"const": "x"}, {"type": "string"}]}, "q": {"type": "number"}, "l": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "boolean"}}}}}},
    "types.json": {"definitions": {"whole": {"type": "integer"}}},
}


def _bound(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"n":'), F.col("o_orderkey").cast("string"), F.lit(',"s":"x","q":1.5,"l":[{"b":true},{}],"z":null}'))
    return records.flatten(_spread(_t(spark, d, "orders")).select(F.col("o_orderkey").alias("record_id"), text.alias("record_json")))


@query("""select o_orderkey, unnest(['n', 's', 'q', 'l[0].b', 'l[1]', 'z']) as display, unnest([3, 2, -1, 1, 7, -1]) as tag from orders""")
def automaton_from_schema(spark, d):
    """A JSON Schema compiled, published, loaded by its content id and walked; a bare number and what isn't declared stay unbound."""
    automaton, untyped = artifacts.compile_schema(_SCHEMA, "order.json")
    sources = [{"sourceId": n, "kind": "content", "uri": f"urn:{n}", "digest": "sha256:" + "0" * 64} for n in _SCHEMA]
    data = artifacts.write(artifacts.artifact(automaton, "test.order", "1.0", "1.0.0", sources, untyped))
    a = artifacts.load(data, artifacts.content_id(data))
    return typing.bind(_bound(spark, d), a.automaton()).select(F.col("record_id").cast("long").alias("o_orderkey"), display_path(F.col("path")).alias("display"), F.coalesce("tag", F.lit(-1)).alias("tag"))


@query("""select * from (values ('binding', '1', 1), ('binding', '2', 1), ('binding', '3', 1), ('binding', '6', 1), ('binding', '7', 1), ('index', '', 1), ('key', '', 5)) t(what, tag, n)""")
def artifact_coverage(spark, d):
    """Transitions and outputs of the compiled map, counted from its tables."""
    automaton, _ = artifacts.compile_schema(_SCHEMA, "order.json")
    keys, index, outputs = artifacts.Artifact("x", {"automaton": automaton}).tables(spark)
    parts = [outputs.select(F.lit("binding").alias("what"), F.col("tag").cast("string").alias("tag")), index.select(F.lit("index").alias("what"), F.lit("").alias("tag")), keys.select(F.lit("key").alias("what"), F.lit("").alias("tag"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("what", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, display, case when display = 'n' and o_orderkey % 4 < 3 then case o_orderkey % 4 when 1 then 4 else 3 end else -1 end as tag from (select o_orderkey, unnest(['n', 's', 'q', 'l[0].b', 'l[1]', 'z']) as display from orders)""")
def exact_map(spark, d):
    """Each record's own map by type, version and id; another version or id binds nothing."""
    k = F.col("record_id").cast("long") % 4
    whole = artifacts.Artifact("x", {"automaton": {"start": "s0", "states": [{"id": "s0", "keys": [{"key": "n", "to": "s1"}]}, {"id": "s1", "bindings": [{"jsonKind": "number", "tag": C.INTEGER}]}]}}).automaton()
    maps = {("a", "1", None): PatternMap([("n", "number", C.INTEGER)]), ("b", "1", "m"): PatternMap([("n", "number", C.DECIMAL)]), ("c", "1", "m"): whole, ("d", "1", None): whole}
    rows = _bound(spark, d).withColumns({"record_type": F.element_at(F.array(*map(F.lit, "abcd")), k.cast("int") + 1), "schema_version": F.when(k == 3, F.lit("2")).otherwise(F.lit("1")), "type_map_id": F.when(k.isin(1, 2), F.lit("m"))})
    return typing.bind(rows, maps).select(F.col("record_id").cast("long").alias("o_orderkey"), display_path(F.col("path")).alias("display"), F.coalesce("tag", F.lit(-1)).alias("tag"))


# ---- rules and reports


@query("select p_partkey, case when p_size % 5 = 0 then 'value-type-mismatch' else 'value-rule' end as reason from part where p_size % 5 = 0 or p_size - 20 <= 0")
def value_rules(spark, d):
    """A rule for positive integers, over sizes from -19 on, some of which are strings."""
    size = F.col("p_size") - 20
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit("t.x").alias("record_type"), path("doses", F.lit(0), "n").alias("path"), F.when(F.col("p_size") % 5 == 0, C.STRING).otherwise(C.INTEGER).alias("tag"), size.cast("string").alias("carrier"))
    return issue.value_rules(rows, [("t.x", ("doses", None, "n"), "positive", "[1-9][0-9]*"), ("t.y", ("doses", None, "n"), "never", "")]).select(F.col("record_id").alias("p_partkey"), "reason")


@query("select sha256((c_custkey % 700)::varchar)[1:32] as salt, count(*) as times, count(distinct c_nationkey) as issuances from customer group by 1 having count(*) > 1")
def shared_salts(spark, d):
    salt = F.unhex(F.substring(F.sha2((F.col("c_custkey") % 700).cast("string"), 256), 1, 32))
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("issuance"), F.col("c_custkey").alias("record_id"), F.lit("p").alias("encoded_path"), salt.alias("salt"))
    return issue.shared_salts(rows).withColumn("salt", binary.to_hex(F.col("salt")))


@query("select o_orderkey, i as pos, sha256(o_orderkey || '-' || i)[1:32] as salt, null as reason from orders, (select unnest([0, 1, 2]) as i) where o_orderkey % 5 > 0 union all select o_orderkey, -1, null, 'salts-length-not-leaf-count' from orders where o_orderkey % 5 = 0")
def salt_sets(spark, d):
    k = F.col("o_orderkey")
    salts = F.concat_ws('","', *[F.substring(F.sha2(F.concat(k.cast("string"), F.lit(f"-{i}")), 256), 1, 32) for i in range(3)])
    text = F.concat(F.lit('{"pairing":"positional","leafCount":'), F.when(k % 5 == 0, F.lit("4")).otherwise(F.lit("3")), F.lit(',"salts":["'), salts, F.lit('"]}'))
    _, by_place, refused = envelopes.read_salt_sets(_spread(_t(spark, d, "orders")).select(k.alias("set_id"), text.alias("salts_json")))
    good = by_place.select(F.col("record_id").cast("long").alias("o_orderkey"), F.col("pos").cast("int").alias("pos"), binary.to_hex(F.col("salt")).alias("salt"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(refused.select(F.col("set_id").cast("long").alias("o_orderkey"), "reason"), allowMissingColumns=True).withColumn("pos", F.coalesce("pos", F.lit(-1)))


@query("select event_type, count(*) as n, count(*) filter (where event_id % 3 = 0) as passed from events group by 1")
def result_tally(spark, d):
    return issue.tally(_t(spark, d, "events"), "event_type", F.col("event_id") % 3 == 0)


@query("with l as (select l_orderkey, l_linenumber from lineitem), w as (select distinct * from l union all select -o_orderkey, 1 from orders where o_orderkey % 10 = 0) select 'extra' as what, * from (select * from l except all select * from w) union all select 'missing', * from (select * from w except all select * from l)")
def set_differences(spark, d):
    """Rows too many and too few against a wanted set."""
    found = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    wanted = found.distinct().unionByName(_t(spark, d, "orders").filter("o_orderkey % 10 = 0").select((-F.col("o_orderkey")).alias("l_orderkey"), F.lit(1).alias("l_linenumber")))
    extra, missing = issue.differences(found, wanted)
    return extra.withColumn("what", F.lit("extra")).unionByName(missing.withColumn("what", F.lit("missing")))


@query("select c_nationkey, count(*) - count(distinct c_custkey // 3) as twice from customer group by 1 having count(*) > count(distinct c_custkey // 3)")
def leaf_hash_collision_planted(spark, d):
    """Records that hold one leaf more than once are found, and only they."""
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("record_id"), F.sha2(F.floor(F.col("c_custkey") / 3).cast("string"), 256).alias("leaf_hash"))
    found = leaves.collisions(rows)
    return rows.join(found, "record_id").groupBy(F.col("record_id").alias("c_nationkey")).agg((F.count(F.lit(1)) - F.count_distinct("leaf_hash")).alias("twice"))

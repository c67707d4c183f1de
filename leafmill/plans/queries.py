"""Queries over the test tables, one or more for each operator, with the SQL that DuckDB answers them with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import binary, merkle, numbers, values
from leafmill.functions.paths import display_path, encode_path, path
from leafmill.functions.text import nfc
from leafmill.operators import giant, issue, leaves, tabular, typing, verify
from leafmill.sources import records
from leafmill.sources.type_maps import Automaton, PatternMap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOMAIN = merkle.domain().hex()
DOMAIN_HASH = merkle.domain("hash").hex()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where they were read in fewer parts than these; a table of many files stays as it is."""
    n = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def _work(spark: SparkSession) -> str:
    """A new folder that all executors see; a temporary one only where everything runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="leafmill-")
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


def _salt(*parts: Column) -> Column:
    """A salt for tests, from a name. Issued records draw theirs (operators.leaves.draw_salts)."""
    return F.unhex(F.substring(F.sha2(F.concat(F.lit("salt|"), F.concat_ws("|", *parts)).cast("binary"), 256), 1, 32))


def _test_salt(record_id: str, display: str) -> bytes:
    """``_salt`` in Python."""
    return sha256(f"salt|{record_id}|{display}".encode()).digest()[:16]


# ---- scalars


@query("select o_orderkey, printf('%08x', o_orderkey) as hex from orders")
def u32be(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", binary.to_hex(binary.u32be(F.col("o_orderkey"))).alias("hex"))


@query("select o_orderkey, printf('%016x', o_orderkey * 1000003) as hex from orders")
def u64be(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", binary.to_hex(binary.u64be(F.col("o_orderkey") * 1000003)).alias("hex"))


@query("select c_custkey, lower(hex(encode(c_name))) as hex, c_name as back, true as upper_refused from customer")
def hex_roundtrip(spark, d):
    h = binary.to_hex(F.encode("c_name", "UTF-8"))
    return _t(spark, d, "customer").select("c_custkey", h.alias("hex"), F.decode(binary.from_hex(h), "UTF-8").alias("back"), binary.from_hex(F.concat(F.lit("AB"), h)).isNull().alias("upper_refused"))


_INTEGERS = "[{k}, '-' || {k}, '-0', '0' || {k}, {k} || '.0', '+' || {k}, repeat('9', 1024), repeat('9', 1025)]"


@query(
    f"""with v as (select o_orderkey, unnest({_INTEGERS.format(k="o_custkey::varchar")}) as s from orders where o_orderkey % 50 = 1)
    select o_orderkey, sha256(s) as s, case when regexp_full_match(s, '-?(0|[1-9][0-9]*)') and length(ltrim(s, '-')) <= 1024 then case when s = '-0' then '0' else s end end as canonical,
    case when not regexp_full_match(s, '-?(0|[1-9][0-9]*)') then 'integer-grammar' when length(ltrim(s, '-')) > 1024 then 'digit-bound-exceeded' end as reason from v"""
)
def canonical_integer_sample(spark, d):
    """The rows that the SQL looks at."""
    return canonical_integer(spark, d).filter("o_orderkey % 50 = 1")


@query()
def canonical_integer(spark, d):
    k = F.col("o_custkey").cast("string")
    v = F.array(k, F.concat(F.lit("-"), k), F.lit("-0"), F.concat(F.lit("0"), k), F.concat(k, F.lit(".0")), F.concat(F.lit("+"), k), F.repeat(F.lit("9"), F.lit(1024)), F.repeat(F.lit("9"), F.lit(1025)))
    rows = _spread(_t(spark, d, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.explode(v).alias("s"))
    return rows.select("o_orderkey", F.sha2("s", 256).alias("s"), numbers.canonical_integer(F.col("s")).alias("canonical"), numbers.integer_reason(F.col("s")).alias("reason"))


_GRAMMAR = "(-?)(0|[1-9][0-9]*)(?:\\.([0-9]+))?(?:[eE]([+-]?)([0-9]+))?"


@query(
    f"""with v as (select l_orderkey, l_linenumber, unnest([q || '.50', q || 'e2', '-' || q || '.0e-3', '-0.00', q || '.250E+1', q || 'e-5', q || '.', '.5', '0' || q, q || 'e1024', '1e1023', q || 'e99999999999', '0e5']) as s
      from (select *, (l_quantity::int)::varchar as q from lineitem) where l_orderkey % 20 = 1),
    g as (select *, regexp_full_match(s, '{_GRAMMAR}') as ok, regexp_extract(s, '^{_GRAMMAR}$', ['sign', 'i', 'f', 'es', 'e']) as r from v),
    p as (select *, r.i || r.f as digits, length(regexp_replace(r.e, '^0+', '')) > 6 as huge from g),
    e as (select *, length(r.i) + case when r.es = '-' then -1 else 1 end * case when huge or r.e = '' then 0 else try_cast(r.e as bigint) end as point from p),
    b as (select *, ok and not huge and greatest(length(digits), point, length(digits) - point) <= 1024 as good from e),
    w as (select *, case when point > 0 then substr(digits || repeat('0', greatest(0, least(1024, point - length(digits)))), 1, point) else '' end as a,
      case when point > 0 then substr(digits, point + 1) else repeat('0', greatest(0, least(1024, -point))) || digits end as f from b)
    select l_orderkey, l_linenumber, s, case when good then case when r.sign = '-' and regexp_matches(digits, '[1-9]') then '-' else '' end || case when ltrim(a, '0') = '' then '0' else ltrim(a, '0') end || case when f = '' then '' else '.' || f end end as canonical,
    case when not ok then 'decimal-grammar' when not good then 'digit-bound-exceeded' end as reason from w"""
)
def canonical_decimal_sample(spark, d):
    """The rows that the SQL looks at."""
    return canonical_decimal(spark, d).filter("l_orderkey % 20 = 1")


@query()
def canonical_decimal(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    c = lambda a, b: F.concat(F.lit(a), q, F.lit(b))
    v = F.array(c("", ".50"), c("", "e2"), c("-", ".0e-3"), F.lit("-0.00"), c("", ".250E+1"), c("", "e-5"), c("", "."), F.lit(".5"), c("0", ""), c("", "e1024"), F.lit("1e1023"), c("", "e99999999999"), F.lit("0e5"))
    rows = _spread(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", F.explode(v).alias("s"))
    return rows.withColumns({"canonical": numbers.canonical_decimal(F.col("s")), "reason": numbers.decimal_reason(F.col("s"))})


@query(
    """select p_partkey, tag, case tag when 2 then lower(hex(encode(p_name))) when 3 then lower(hex(encode(p_size::varchar))) when 4 then lower(hex(encode(p_retailprice::decimal(18,2)::varchar)))
    when 1 then case when p_size > 20 then '01' else '00' end else '' end as hex from part, (select unnest([0, 1, 2, 3, 4, 6, 7]) as tag)"""
)
def encode_value(spark, d):
    p = _t(spark, d, "part").withColumn("tag", F.explode(F.array(*[F.lit(t) for t in (0, 1, 2, 3, 4, 6, 7)])))
    tag = F.col("tag")
    v = F.when(tag == 1, (F.col("p_size") > 20).cast("string")).when(tag == 2, F.col("p_name")).when(tag == 3, F.col("p_size").cast("string")).when(tag == 4, F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    return p.select("p_partkey", "tag", binary.to_hex(values.encode_value(tag, v)).alias("hex"))


@query("select p_partkey, printf('%016x', p_size) || '00000020' || sha256(p_name) as hex from part")
def blob_ref(spark, d):
    return _t(spark, d, "part").select("p_partkey", binary.to_hex(values.blob_ref(F.col("p_size"), F.unhex(F.sha2("p_name", 256)))).alias("hex"))


@query("select doc_id, sha256(nfc_normalize('e' || chr(769) || text || 'o' || chr(776))) as digest from documents")
def nfc_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(nfc(F.concat(F.lit("é"), F.col("text"), F.lit("ö"))), 256).alias("digest"))


@query(
    """with v as (select p_partkey, p_name, unnest([b, rtrim(b, '=') || '!', b || chr(10), replace(b, '=', '') || '=', '']) as s, unnest([1, 2, 3, 4, 5]) as n from (select *, to_base64(encode(p_name)) as b from part))
    select p_partkey, n, case when n = 1 or n = 4 and octet_length(encode(p_name)) % 3 = 2 then lower(hex(encode(p_name))) when n = 5 then '' end as hex from v"""
)
def base64_strict(spark, d):
    b = F.regexp_replace(F.base64(F.encode("p_name", "UTF-8")), "[\r\n]", "")
    v = F.array(b, F.concat(F.rtrim(b, F.lit("=")), F.lit("!")), F.concat(b, F.lit("\n")), F.concat(F.replace(b, F.lit("="), F.lit("")), F.lit("=")), F.lit(""))
    return _t(spark, d, "part").select("p_partkey", F.posexplode(v).alias("n", "s")).select("p_partkey", (F.col("n") + 1).alias("n"), binary.to_hex(binary.from_base64(F.col("s"))).alias("hex"))


@query(f"select doc_id, 'sha256:' || sha256(unhex('{C.TYPE_MAP_DOMAIN.hex()}') || encode(text)) as id from documents")
def content_id(spark, d):
    return _t(spark, d, "documents").select("doc_id", binary.content_id(F.encode("text", "UTF-8")).alias("id"))


@query("select o_orderkey, (1::bigint << (length(bin(o_orderkey)) - 1)) as split from orders where o_orderkey > 0")
def split_point(spark, d):
    return _t(spark, d, "orders").filter("o_orderkey > 0").select("o_orderkey", merkle.split_point(F.col("o_orderkey") + 1).alias("split"))


@query("select p_partkey, p_size > 0 and regexp_full_match(p_size::varchar, '[1-9][0-9]*') as fits from part")
def value_rule_positive_integer(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").rlike(r"\A[1-9][0-9]*\z").alias("fits"))


# ---- leaves of orders

_CELLS = {"l_partkey": C.INTEGER, "l_quantity": C.DECIMAL, "l_returnflag": C.STRING, "l_shipdate": C.STRING}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a text column for each cell and the place of each row in its order."""
    l = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("l_quantity"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    # Rows that tie here have equal cells.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")) - 1
    return l.withColumn("i", place)


def _record(key: Column) -> Column:
    return F.concat(F.lit("order-"), key.cast("string"))


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    return tabular.cells(_lines(spark, d), _record(F.col("l_orderkey")), "lines", F.col("i"), {c: (t, F.col(c).cast("string")) for c, t in _CELLS.items()})


def order_records(spark: SparkSession, d: str, *more: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _t(spark, d, "orders").select(*more, _record(F.col("o_orderkey")).alias("record_id"), F.lit("test.order").alias("record_type"), F.lit("1.0").alias("schema_version"), none.alias("type_map_id"), F.concat(F.lit("urn:"), F.col("o_orderpriority")).alias("issuer_id"), F.when(F.col("o_orderstatus") == "F", F.lit("key-1")).alias("issuer_key_id"))


def _encoded_cells(spark: SparkSession, d: str) -> DataFrame:
    return leaves.encoded(order_cells(spark, d).withColumn("reserved", F.lit(False)), ascii_only=True)


def _hashed_cells(spark: SparkSession, d: str, ordering: str = "path") -> DataFrame:
    rows = _encoded_cells(spark, d)
    return leaves.hashed(rows.withColumn("salt", _salt(F.col("record_id"), display_path(F.col("path")))), ordering)


_SQL_LINES = """lines as (select 'order-' || l_orderkey as record_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::decimal(18,2)::varchar, l_returnflag, l_shipdate) - 1 as i,
  l_partkey::varchar as l_partkey, l_quantity::decimal(18,2)::varchar as l_quantity, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') as l_shipdate from lineitem)"""


def _key_sql(key: str) -> str:
    return f"01{len(key):08x}{key.encode().hex()}"


_SQL_CELLS = f"""{_SQL_LINES}, cells as ({" union all ".join(f"select record_id, 'lines[' || i || '].{c}' as display, '00000003{_key_sql("lines")}02' || printf('%08x', i) || '{_key_sql(c)}' as p, {t} as tag, {c} as v from lines" for c, t in _CELLS.items())})"""


def _hash_sql(source: str, domain: str = DOMAIN) -> str:
    return f"""(select *, sha256(unhex('00' || '{len(domain) // 2:08x}{domain}' || printf('%08x', length(p) // 2) || p || printf('%02x', tag) || '00000010' || substr(sha256('salt|' || record_id || '|' || display), 1, 32) || printf('%016x', strlen(v)) || lower(hex(encode(v))))) as h from {source})"""


def _levels_sql(source: str, order: str = "p, h") -> str:
    """Recursive levels of the trees of (record_id, p, h)."""
    return f"""levels as (select 0 as l, record_id, row_number() over (partition by record_id order by {order}) - 1 as i, count(*) over (partition by record_id) as n, h from {source}
      union all select l + 1, record_id, i // 2, (n + 1) // 2, case when count(*) = 2 then sha256(unhex('01' || min_by(h, i) || max_by(h, i))) else min(h) end from levels where n > 1 group by l, record_id, i // 2, n)"""


@query(f"with {_SQL_CELLS} select record_id, display, p as encoded_path from cells")
def encode_paths(spark, d):
    rows = order_cells(spark, d)
    return rows.select("record_id", display_path(F.col("path")).alias("display"), binary.to_hex(encode_path(F.col("path"))).alias("encoded_path"))


@query(f"with {_SQL_CELLS} select record_id, display, h as leaf_hash from {_hash_sql('cells')}")
def leaf_hashes(spark, d):
    rows = _hashed_cells(spark, d)
    return rows.select("record_id", display_path(F.col("path")).alias("display"), binary.to_hex(F.col("leaf_hash")).alias("leaf_hash"))


@query("select event_id, 'k' as display, 'number' as json_kind, regexp_extract(props, ': *([0-9]+)', 1) as literal from events")
def flatten_events(spark, d):
    rows = records.flatten(_t(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("props").alias("record_json")))
    return rows.select(F.col("record_id").cast("long").alias("event_id"), display_path(F.col("path")).alias("display"), "json_kind", "literal")


@query(
    """select o_orderkey, unnest(['n', 'e', 'big', 't', 'o', 'a[0]']) as display, unnest(['number', 'number', 'number', 'boolean', 'object', 'null']) as json_kind,
    unnest([o_orderkey || '.010', '1e2', '9223372036854775808', 'true', null, null]) as literal from orders where o_orderkey % 10 = 1"""
)
def json_literals_sample(spark, d):
    """The rows that the SQL looks at."""
    return json_literals(spark, d).filter("o_orderkey % 10 = 1")


@query()
def json_literals(spark, d):
    text = F.concat(F.lit('{"n":'), F.col("o_orderkey").cast("string"), F.lit('.010,"e":1e2,"big":9223372036854775808,"t":true,"o":{},"a":[null]}'))
    rows = records.flatten(_t(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), text.alias("record_json")))
    return rows.select(F.col("record_id").cast("long").alias("o_orderkey"), display_path(F.col("path")).alias("display"), "json_kind", "literal")


@query(
    """select o_orderkey, case o_orderkey % 6 when 0 then 'duplicate-key' when 1 then 'non-finite-number' when 2 then 'json-syntax' when 3 then 'unpaired-surrogate' when 4 then 'json-syntax' end as reason from orders"""
)
def json_rejections(spark, d):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.lit('{"a":1,"a":2}')).when(k == 1, F.lit('{"a":NaN}')).when(k == 2, F.lit('{"a":01}')).when(k == 3, F.lit('{"a":"\\ud800"}')).when(k == 4, F.lit('{"a":1} x')).otherwise(F.lit('{"a":1}'))
    rows = records.flatten(_t(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), text.alias("record_json")))
    return rows.select(F.col("record_id").cast("long").alias("o_orderkey"), "reason")


def _reserved_sql(key: str, value: str, where: str = "true") -> str:
    return f"select 'order-' || o_orderkey as record_id, '{key}' as display, '00000001{_key_sql(key)}' as p, 2 as tag, {value} as v from orders where {where}"


_SQL_RESERVED = "reserved as (" + " union all ".join([_reserved_sql(C.RECORD_TYPE, "'test.order'"), _reserved_sql(C.SCHEMA_VERSION, "'1.0'"), _reserved_sql(C.RECORD_ID, "'order-' || o_orderkey"), _reserved_sql(C.ISSUER_ID, "'urn:' || o_orderpriority"), _reserved_sql(C.ISSUER_KEY_ID, "'key-1'", "o_orderstatus = 'F'")]) + ")"


@query(f"with {_SQL_RESERVED} select record_id, display, v as literal from reserved")
def reserved_leaves(spark, d):
    return leaves.reserved_leaves(order_records(spark, d)).select("record_id", display_path(F.col("path")).alias("display"), "literal")


@query(f"with {_SQL_CELLS}, {_SQL_RESERVED}, u as (select record_id, tag from cells union all select record_id, tag from reserved) select record_id, tag, count(*) as n from u group by all")
def leaf_union(spark, d):
    both = order_cells(spark, d).select("record_id", "tag").unionByName(leaves.reserved_leaves(order_records(spark, d)).select("record_id", "tag"))
    return both.groupBy("record_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, p_partkey % 3 = 0 as guarded from part")
def reserved_guard(spark, d):
    key = F.when(F.col("p_partkey") % 3 == 0, F.lit(C.RESERVED_PREFIX + "x")).when(F.col("p_partkey") % 3 == 1, F.lit(C.RESERVED_PREFIX.rstrip("."))).otherwise(F.lit("a"))
    p = F.array(F.struct(key.alias("key"), F.lit(None).cast("bigint").alias("index")), F.struct(F.lit(C.RESERVED_PREFIX + "y").alias("key"), F.lit(None).cast("bigint").alias("index")))
    rows = _t(spark, d, "part").select("p_partkey", p.alias("path"))
    guarded = leaves.guard(rows).select(F.col("p_partkey").alias("k"))
    return rows.join(guarded, rows["p_partkey"] == guarded["k"], "left").select("p_partkey", F.col("k").isNotNull().alias("guarded"))


# ---- type maps

_MAP = PatternMap([("lines[*].l_partkey", "number", C.INTEGER), ("lines[*].l_quantity", "number", C.DECIMAL), ("lines[*].l_partkey", "number", C.DECIMAL), ("lines[*].l_shipdate", "string", C.STRING), ("lines.**", "string", C.BYTES)])
_BOUND = "case when display like '%l_partkey' then 3 when display like '%l_quantity' then 4 when display like '%l_shipdate' then 2 end"


def _unbound(spark: SparkSession, d: str) -> DataFrame:
    return order_cells(spark, d).drop("tag").withColumn("display", display_path(F.col("path")))


@query(f"with {_SQL_CELLS} select record_id, display, {_BOUND.replace(' end', '')} else 5 end as tag from cells")
def typemap_first_match(spark, d):
    return typing.by_patterns(_unbound(spark, d), _MAP).select("record_id", "display", "tag")


@query(f"with {_SQL_CELLS} select record_id, display from cells where {_BOUND} is null")
def typemap_fail_closed(spark, d):
    return typing.fail_closed(typing.by_patterns(_unbound(spark, d), PatternMap(_MAP.entries[:-1]))).select("record_id", "display")


@query(f"with {_SQL_CELLS} select record_id, display, coalesce({_BOUND}, -1) as tag from cells")
def dfa_walk(spark, d):
    a = Automaton(0, {(0, "lines"): 1, (2, "l_partkey"): 3, (2, "l_quantity"): 4, (2, "l_shipdate"): 5}, {1: 2}, {(3, "number"): C.INTEGER, (4, "number"): C.DECIMAL, (5, "string"): C.STRING})
    rows = _unbound(spark, d)
    return rows.select("record_id", "display", F.coalesce(typing.walk_automaton(F.col("path"), F.col("json_kind"), a), F.lit(-1)).alias("tag"))


@query("select tag, count(*) as entries from (values (3), (4), (4), (2), (5)) t(tag) group by tag")
def coverage_summary(spark, d):
    return _MAP.table(spark).groupBy("tag").agg(F.count(F.lit(1)).alias("entries"))


# ---- order, salts


@query(f"with {_SQL_CELLS} select record_id, display, row_number() over (partition by record_id order by p) - 1 as leaf_index from cells")
def leaf_order(spark, d):
    return leaves.ordered(_hashed_cells(spark, d)).select("record_id", display_path(F.col("path")).alias("display"), "leaf_index")


@query(f"with {_SQL_CELLS} select record_id, display, row_number() over (partition by record_id order by h) - 1 as leaf_index from {_hash_sql('cells', DOMAIN_HASH)}")
def hash_order(spark, d):
    return leaves.ordered(_hashed_cells(spark, d, "hash"), "hash").select("record_id", display_path(F.col("path")).alias("display"), "leaf_index")


@query("select 0::bigint as records")
def leaf_hash_collision(spark, d):
    return leaves.collisions(_hashed_cells(spark, d)).agg(F.count(F.lit(1)).alias("records"))


@query(f"with {_SQL_CELLS} select count(*) as shared from (select h from {_hash_sql('cells')} intersect select h from {_hash_sql('cells', DOMAIN_HASH)})")
def ordering_disjoint(spark, d):
    return _hashed_cells(spark, d).select("leaf_hash").intersect(_hashed_cells(spark, d, "hash").select("leaf_hash")).agg(F.count(F.lit(1)).alias("shared"))


@query("select 'order-' || l_orderkey as record_id, l_linenumber::varchar as line, count(*) as times from lineitem group by all having count(*) > 1")
def duplicate_path(spark, d):
    rows = _t(spark, d, "lineitem").select(_record(F.col("l_orderkey")).alias("record_id"), F.encode(F.col("l_linenumber").cast("string"), "UTF-8").alias("encoded_path"))
    return leaves.duplicate_paths(rows).select("record_id", F.decode("encoded_path", "UTF-8").alias("line"), "times")


def _salts(spark: SparkSession, d: str) -> DataFrame:
    """Salts for the cells of all orders but each thirteenth."""
    rows = _encoded_cells(spark, d).withColumn("salt", _salt(F.col("record_id"), display_path(F.col("path"))))
    return rows.filter(F.substring_index("record_id", "-", -1).cast("long") % 13 != 0).select("record_id", "encoded_path", "salt")


@query(f"with {_SQL_CELLS} select record_id, display, case when split_part(record_id, '-', 2)::bigint % 13 <> 0 then substr(sha256('salt|' || record_id || '|' || display), 1, 32) end as salt from cells")
def salt_join(spark, d):
    return leaves.with_salts(_encoded_cells(spark, d), _salts(spark, d)).select("record_id", display_path(F.col("path")).alias("display"), binary.to_hex(F.col("salt")).alias("salt"))


@query(f"with {_SQL_CELLS} select record_id, display from cells where split_part(record_id, '-', 2)::bigint % 13 = 0")
def salt_missing(spark, d):
    return leaves.missing_salts(_encoded_cells(spark, d), _salts(spark, d)).select("record_id", display_path(F.col("path")).alias("display"))


@query(f"with {_SQL_CELLS}, o as (select *, row_number() over (partition by record_id order by p) - 1 as pos from cells) select record_id, display, substr(sha256('salt|' || record_id || '|' || pos), 1, 32) as salt from o")
def salt_positional(spark, d):
    rows = _encoded_cells(spark, d)
    n = rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    salts = n.select("record_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos")).withColumn("salt", _salt(F.col("record_id"), F.col("pos").cast("string")))
    return leaves.with_salts_by_place(rows, salts).select("record_id", display_path(F.col("path")).alias("display"), binary.to_hex(F.col("salt")).alias("salt"))


@query(f"with {_SQL_CELLS} select count(*) as leaves, count(distinct substr(sha256('salt|' || record_id || '|' || display), 1, 32)) as salts from cells")
def salt_distinct(spark, d):
    return _hashed_cells(spark, d).agg(F.count(F.lit(1)).alias("leaves"), F.countDistinct("salt").alias("salts"))


# ---- trees and proofs


@query(f"with recursive {_SQL_CELLS}, hashes as {_hash_sql('cells')}, {_levels_sql('hashes')} select l.record_id, c.n as leaf_count, l.h as root from levels l join (select record_id, count(*) as n from cells group by 1) c on l.record_id = c.record_id where l.n = 1")
def merkle_root_by_order(spark, d):
    return leaves.trees(_hashed_cells(spark, d)).select("record_id", F.col("leaf_count").cast("long").alias("leaf_count"), binary.to_hex(F.col("root")).alias("root"))


@query(f"with recursive hashes as (select 'all' as record_id, c_custkey as p, sha256(c_name) as h from customer), {_levels_sql('hashes')} select (select count(*) from customer) as leaf_count, h as root from levels where n = 1")
def merkle_root_table(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.unhex(F.sha2("c_name", 256)).alias("leaf_hash"))
    return giant.table_root(rows, ["c_custkey"], _work(spark)).select("leaf_count", binary.to_hex(F.col("root")).alias("root"))


@query(
    f"""with recursive {_SQL_CELLS}, hashes as {_hash_sql('cells')}, {_levels_sql('hashes')},
    a as (select x.record_id, x.i as leaf_index, s.h, s.l from levels x join levels s on x.record_id = s.record_id and x.l = 0 and s.n > 1 and s.i = xor(x.i >> s.l, 1))
    select x.record_id, x.i as leaf_index, coalesce(string_agg(a.h, '' order by a.l), '') as audit_path from levels x left join a on a.record_id = x.record_id and a.leaf_index = x.i where x.l = 0 group by all"""
)
def audit_paths(spark, d):
    rows = leaves.audit_paths(_hashed_cells(spark, d))
    return rows.select("record_id", F.col("leaf_index").cast("long").alias("leaf_index"), F.array_join(F.transform("audit_path", binary.to_hex), "").alias("audit_path"))


@query(f"with {_SQL_CELLS}, c as (select record_id, count(*) as n from cells group by 1) select record_id, n as good, n as proven, 0::bigint as forged from c")
def verify_inclusion(spark, d):
    """Every proof holds; with another leaf's index, an extra step, a changed sibling or a wrong root none does."""
    rows = leaves.audit_paths(_hashed_cells(spark, d))
    check = lambda **x: merkle.verify_inclusion(*[x.get(n, F.col(n)) for n in ("leaf_hash", "leaf_index", "leaf_count", "audit_path", "root")])
    longer = F.concat("audit_path", F.array("leaf_hash"))
    changed = F.transform("audit_path", lambda h: merkle.sha256(h))
    forged = check(audit_path=longer).cast("long") + check(root=merkle.sha256(F.col("root"))).cast("long") + check(leaf_index=F.col("leaf_count")).cast("long") + F.when(F.size("audit_path") > 0, check(audit_path=changed).cast("long") + check(audit_path=F.slice("audit_path", 1, F.size("audit_path") - 1)).cast("long")).otherwise(0)
    return rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("good"), F.sum(check().cast("long")).alias("proven"), F.sum(forged).alias("forged"))


_SQL_ALL = f"{_SQL_CELLS}, {_SQL_RESERVED}, both_ as (select * from cells union all select * from reserved where record_id in (select record_id from cells))"


@query(
    f"""with recursive {_SQL_ALL}, hashes as {_hash_sql('both_')}, {_levels_sql('hashes')}, r as (select record_id, count(*) as k from reserved group by 1),
    c as (select record_id, count(*) as n from both_ group by 1)
    select r.record_id, coalesce(c.n, r.k) as leaf_count, l.h as root, case when c.n is null then 'record-contributes-no-leaves' end as reason from r left join c using (record_id) left join levels l on l.record_id = r.record_id and l.n = 1"""
)
def commit_orders(spark, d):
    """The whole way: cells and identity to leaves, salts by path, hashes, roots; orders without lines are refused."""
    cells, recs = order_cells(spark, d), order_records(spark, d)
    # Salts are made from how many lines an order has; nothing of the lines is read or sorted for them.
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n")).select(_record(F.col("l_orderkey")).alias("record_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    own = lines.select("record_id", F.explode(F.array(*[path("lines", F.col("i"), c) for c in _CELLS])).alias("path"))
    named = own.unionByName(leaves.reserved_leaves(recs).select("record_id", "path"))
    salts = named.select("record_id", encode_path(F.col("path")).alias("encoded_path"), _salt(F.col("record_id"), display_path(F.col("path"))).alias("salt"))
    _, roots = leaves.commit(recs, cells, salts, ascii_only=True)
    return roots.select("record_id", F.col("leaf_count").cast("long").alias("leaf_count"), binary.to_hex(F.col("root")).alias("root"), "reason")


# ---- disclosure


def _asked(rows: DataFrame, ending: str) -> DataFrame:
    return rows.filter(display_path(F.col("path")).endswith(ending)).select("record_id", "encoded_path")


@query(f"with {_SQL_CELLS} select record_id, display, row_number() over (partition by record_id order by p) - 1 as leaf_index, true as proven from cells qualify display like '%l_partkey'")
def disclose_and_verify(spark, d):
    rows = _hashed_cells(spark, d)
    none = rows.limit(0).select("record_id", "encoded_path")
    shown, _, _ = leaves.disclose(rows, _asked(rows, "l_partkey"), none)
    return leaves.verify_leaves(shown).select("record_id", F.col("display_path").alias("display"), "leaf_index", "proven")


@query(f"with {_SQL_CELLS} select record_id, display from cells where display = 'lines[0].l_shipdate'")
def disclosure_floor(spark, d):
    """The first line's date must be shown and isn't."""
    rows = _hashed_cells(spark, d)
    _, _, below = leaves.disclose(rows, _asked(rows, "l_partkey"), _asked(rows, "lines[0].l_shipdate").unionByName(_asked(rows, "lines[0].l_partkey")))
    return below.join(rows.select("record_id", "encoded_path", "path"), ["record_id", "encoded_path"]).select("record_id", display_path(F.col("path")).alias("display"))


@query(f"with {_SQL_CELLS} select record_id, display, display not like '%l_quantity' as proven from cells")
def verify_disclosed_tampered(spark, d):
    """A changed value breaks its own proof and no other."""
    rows = _hashed_cells(spark, d)
    none = rows.limit(0).select("record_id", "encoded_path")
    shown, _, _ = leaves.disclose(rows, rows.select("record_id", "encoded_path"), none)
    bad = shown.withColumn("carrier", F.when(F.col("display_path").endswith("l_quantity"), F.concat(F.col("carrier"), F.lit("0"))).otherwise(F.col("carrier")))
    return leaves.verify_leaves(bad).select("record_id", F.col("display_path").alias("display"), "proven")


@query("select doc_id, true as same from documents")
def normalization_same_root(spark, d):
    """A text and its decomposed form have the same leaf hash."""
    texts = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.explode(F.array(F.concat(F.lit("é"), F.col("text")), F.concat(F.lit("é"), F.col("text")))).alias("literal"))
    rows = texts.select("record_id", path("text").alias("path"), F.lit(C.STRING).alias("tag"), F.lit("string").alias("json_kind"), "literal", F.lit(False).alias("reserved"))
    hashes = leaves.hashed(leaves.encoded(rows).withColumn("salt", _salt(F.col("record_id"))))
    return hashes.groupBy("record_id").agg((F.countDistinct("leaf_hash") == 1).alias("same")).select(F.col("record_id").cast("long").alias("doc_id"), "same")


@query(
    """select *, reason is null as accepted from (select 'order-' || o_orderkey as envelope_id, case when o_orderkey % 5 = 1 then 'master-salt-in-envelope' when o_orderpriority like '% %' or o_orderkey not in (select l_orderkey from lineitem) then 'envelope-malformed'
    when o_orderkey % 5 = 0 then 'outer-identity-mismatch' when o_orderkey % 5 = 2 then 'hash-alg-not-allowed' end as reason from orders)"""
)
def verify_envelopes(spark, d):
    """Disclosed copies of all orders, written as JSON, some of them changed, read and verified. An issuer with a space in its
    name is no URI, and an order without lines has fewer leaves than any record: their copies are malformed."""
    # Only the lines' few columns are shuffled, as they are, to the task that holds their order; a copy is made, changed, read
    # and verified there.
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_CELLS).repartition("l_orderkey")
    # As in _lines: rows that tie here have equal cells.
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("l_quantity"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    by_order = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    recs = order_records(spark, d, "o_orderkey").join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    copies = issue.disclose_tables(recs, "lines", _CELLS, lambda path: path[-1] == "l_partkey", salts=_test_salt, even_bare=True)
    k, text = F.substring_index("record_id", "-", -1).cast("long") % 5, F.col("envelope_json")
    changed = (
        F.when(k == 0, F.replace(text, F.lit('"recordId":"order-'), F.lit('"recordId":"Order-')))
        .when(k == 1, F.replace(text, F.lit('"mode":'), F.lit('"seed":"x","mode":')))
        .when(k == 2, F.replace(text, F.lit(C.HASH_ALG), F.lit("MD5")))
        .otherwise(text)
    )
    changed_copies = copies.select(F.col("record_id").alias("envelope_id"), changed.alias("envelope_json"))
    return verify.verify(changed_copies, {"test.order": []}).drop("undischarged")

"""From typed leaves to committed ones: reserved leaves, the guard, encodings, salts, order, hashes."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import merkle
from leafmill.functions.paths import display_path, encode_path, index_in_range, is_reserved, path
from leafmill.functions.text import nfc
from leafmill.functions.values import carrier, encode_value, value_reason

IDENTITY = ["record_type", "schema_version", "type_map_id", "issuer_id", "issuer_key_id"]


def reserved_leaves(records: DataFrame, ordering: str = "path", identity_id: str = "record_id") -> DataFrame:
    """The identity of each record (record_id and IDENTITY) as leaves: record_id, path, tag, json_kind, literal.

    Absent optional members give no leaf; the ordering is a leaf only where it isn't the default.
    """
    merkle.domain(ordering)
    named = [(C.RECORD_TYPE, F.col("record_type")), (C.SCHEMA_VERSION, F.col("schema_version")), (C.TYPE_MAP_ID, F.col("type_map_id")), (C.RECORD_ID, F.col(identity_id)), (C.ISSUER_ID, F.col("issuer_id")), (C.ISSUER_KEY_ID, F.col("issuer_key_id")), (C.ORDERING, F.lit(ordering if ordering != "path" else None).cast("string"))]
    items = F.array(*[F.when(v.isNotNull(), F.struct(path(k).alias("path"), v.cast("string").alias("literal"))) for k, v in named])
    return records.select("record_id", F.explode(F.array_compact(items)).alias("r")).select("record_id", "r.path", F.lit(C.STRING).alias("tag"), F.lit("string").alias("json_kind"), "r.literal")


def normal_path(p: Column) -> Column:
    """The path with keys in NFC. Its text form goes through the normalizer once, as JSON, since a UDF can't be called
    inside a higher-order function."""
    text = F.to_json(p)
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), p).otherwise(F.from_json(nfc(text), C.PATH_TYPE))


def guard(leaves: DataFrame) -> DataFrame:
    """Leaves of records that use the reserved namespace."""
    return leaves.filter(is_reserved(normal_path(F.col("path")), C.RESERVED_PREFIX))


def encoded(leaves: DataFrame, ascii_only: bool = False) -> DataFrame:
    """leaves (record_id, path, tag, json_kind, literal, reserved) with encoded_path, carrier, encoded_value, reason.

    ascii_only promises that keys and texts are ASCII, which keeps the plan free of Python.
    """
    p = F.col("path") if ascii_only else normal_path(F.col("path"))
    out = leaves.withColumn("path", p).withColumn("encoded_path", encode_path(F.col("path")))
    tag, kind, literal = F.col("tag"), F.col("json_kind"), F.col("literal")
    reason = (
        F.when(~F.col("reserved") & is_reserved(F.col("path"), C.RESERVED_PREFIX), F.lit("reserved-namespace"))
        .when(~index_in_range(F.col("path")), F.lit("index-out-of-32-bit-range"))
        .when(tag.isNull(), F.lit("type-map-fail-closed"))
        .otherwise(value_reason(tag, kind, literal))
    )
    return out.withColumn("reason", reason).withColumn("carrier", F.when(F.col("reason").isNull(), carrier(tag, literal, any_text=not ascii_only))).withColumn("encoded_value", F.when(F.col("reason").isNull(), encode_value(tag, F.col("carrier"), normal=True)))


def draw_salts(leaves: DataFrame, store: str, mode: str = "error") -> DataFrame:
    """Draws a salt from the system's generator for every leaf and returns what was stored: record_id, encoded_path, salt.

    A retried or repeated computation would draw anew, so salts exist only once written; nothing else is ever used.
    """

    @F.pandas_udf("binary")
    def draw(n: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_bytes(C.SALT_BYTES) for _ in range(len(n))])

    drawn = leaves.select("record_id", "encoded_path").withColumn("salt", draw.asNondeterministic()(F.octet_length("encoded_path")))
    drawn.write.mode(mode).parquet(store)
    return leaves.sparkSession.read.parquet(store)


def with_salts(leaves: DataFrame, salts: DataFrame) -> DataFrame:
    """Pairs by record and encoded path; a leaf without salt keeps null. Leaves and salts meet in one shuffle by record,
    which what follows (order, trees) uses again."""
    both = leaves.withColumn("_leaf", F.lit(True)).unionByName(salts.select("record_id", "encoded_path", F.col("salt").alias("_salt")), allowMissingColumns=True)
    same = Window.partitionBy("record_id", "encoded_path")
    return both.repartition("record_id").withColumn("salt", F.max("_salt").over(same)).filter("_leaf").drop("_leaf", "_salt")


def with_salts_by_place(leaves: DataFrame, salts: DataFrame) -> DataFrame:
    """Pairs by record and place (from 0) in path order, for tests: salts has record_id, pos, salt."""
    placed = leaves.withColumn("pos", F.row_number().over(Window.partitionBy("record_id").orderBy("encoded_path")) - 1)
    return placed.join(salts.select("record_id", "pos", "salt"), ["record_id", "pos"], "left").drop("pos")


def missing_salts(leaves: DataFrame, salts: DataFrame) -> DataFrame:
    return leaves.join(salts, ["record_id", "encoded_path"], "left_anti")


def duplicate_paths(rows: DataFrame) -> DataFrame:
    """(record_id, encoded_path) that occur more than once, of leaves or of salts."""
    return rows.groupBy("record_id", "encoded_path").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def hashed(leaves: DataFrame, ordering: str = "path") -> DataFrame:
    return leaves.withColumn("leaf_hash", merkle.leaf_hash(F.col("encoded_path"), F.col("tag"), F.col("encoded_value"), F.col("salt"), ordering))


def ordered(leaves: DataFrame, ordering: str = "path") -> DataFrame:
    """leaves with leaf_index, from 0: by encoded path, or by leaf hash."""
    merkle.domain(ordering)
    by = ["encoded_path", "leaf_hash"] if ordering == "path" else ["leaf_hash"]
    return leaves.withColumn("leaf_index", F.row_number().over(Window.partitionBy("record_id").orderBy(*by)) - 1)


def collisions(leaves: DataFrame) -> DataFrame:
    """Records in which two leaves share a hash."""
    return leaves.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("leaf_hash").alias("d")).filter("d < n").select("record_id")


def trees(leaves: DataFrame, ordering: str = "path") -> DataFrame:
    """One row a record: record_id, leaf_count, root, and hashes in tree order. For records, whose leaves one task holds;
    ``operators.giant`` has roots over whole tables."""
    key = F.struct("encoded_path", "leaf_hash") if ordering == "path" else F.struct("leaf_hash", "encoded_path")
    rows = leaves.groupBy("record_id").agg(F.array_sort(F.collect_list(key)).alias("k"))
    return rows.select("record_id", F.size("k").alias("leaf_count"), F.transform("k", lambda x: x["leaf_hash"]).alias("hashes")).withColumn("root", merkle.root(F.col("hashes")))


def commit(records: DataFrame, typed: DataFrame, salts: DataFrame, ordering: str = "path", ascii_only: bool = False, identity_id: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(leaves, roots) of records. identity_id: the column that is committed as the record's id, where record_id only groups.
    typed: record_id, path, tag, json_kind, literal of the records' own leaves.

    roots: record_id, leaf_count, root, reason - the first reason in path order that any leaf has against it, or that
    of the record (no leaves, paths or hashes twice, a salt missing); a record with a reason has no root.
    """
    own = typed.select("record_id", "path", "tag", "json_kind", "literal", F.lit(False).alias("reserved"))
    both = own.unionByName(reserved_leaves(records, ordering, identity_id).withColumn("reserved", F.lit(True)))
    rows = hashed(with_salts(encoded(both, ascii_only), salts), ordering)
    bad = F.coalesce("reason", F.when(F.col("salt").isNull(), F.lit("salt-missing-for-leaf")), F.when(F.octet_length("salt") != C.SALT_BYTES, F.lit("salt-length")))
    key = F.struct("encoded_path", "leaf_hash") if ordering == "path" else F.struct("leaf_hash", "encoded_path")
    per = rows.groupBy("record_id").agg(
        F.min_by(bad, F.when(bad.isNotNull(), F.struct("reserved", "encoded_path"))).alias("bad"),
        F.sum(F.when(F.col("reserved"), 0).otherwise(1)).alias("own"),
        F.array_sort(F.collect_list(key)).alias("k"),
    )
    hashes = F.transform("k", lambda x: x["leaf_hash"])
    reason = (
        F.when(F.coalesce(F.col("own"), F.lit(0)) == 0, F.lit("record-contributes-no-leaves"))
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.size(F.array_distinct(F.transform("k", lambda x: x["encoded_path"]))) < F.size("k"), F.lit("duplicate-key"))
        .when(F.size(F.array_distinct(hashes)) < F.size("k"), F.lit("leaf-hash-collision"))
    )
    roots = per.select("record_id", F.size("k").alias("leaf_count"), reason.alias("reason"), hashes.alias("hashes"))
    return rows, roots.withColumn("root", F.when(F.col("reason").isNull(), merkle.root(F.col("hashes")))).drop("hashes")


def audit_paths(leaves: DataFrame, ordering: str = "path", *columns: str, only: str | None = None) -> DataFrame:
    """record_id, leaf_index, leaf_count, root, leaf_hash, encoded_path, audit_path of every leaf, and columns of leaves; a
    tree's levels are made once. only: a column that says which leaves' paths are wanted."""
    key = ["encoded_path", "leaf_hash"] if ordering == "path" else ["leaf_hash", "encoded_path"]
    merkle.domain(ordering)
    rows = leaves.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(*key, F.struct(*columns, *([only] if only else []), F.lit(0)).alias("_more")))).alias("k"))
    levels = merkle.levels(F.transform("k", lambda x: x["leaf_hash"]))
    t = rows.select("record_id", "k", levels.alias("levels")).withColumn("root", F.get(F.element_at("levels", -1), F.lit(0)))
    each = t.select("record_id", F.size("k").alias("leaf_count"), "root", "levels", F.posexplode("k").alias("leaf_index", "x"))
    if only:
        each = each.filter(F.col(f"x._more.{only}"))
    return each.select("record_id", "leaf_index", "leaf_count", "root", "x.leaf_hash", "x.encoded_path", merkle.audit_path(F.col("levels"), F.col("leaf_index")).alias("audit_path"), *[f"x._more.{c}" for c in columns])


def disclose(leaves: DataFrame, reveal: DataFrame, floor: DataFrame, ordering: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(disclosed leaves with their proofs, paths asked for that don't exist, floor paths left out).

    leaves: committed leaves of records; reveal and floor: record_id, encoded_path. The mandatory reserved leaves belong
    to the floor. A record with a path in the second or third isn't disclosed at all. All three meet in one shuffle by
    record, and leaves are hashed and put in order once.
    """
    mark = lambda rows, name: rows.select("record_id", "encoded_path", F.lit(True).alias(name))
    both = leaves.withColumn("_leaf", F.lit(True)).unionByName(mark(reveal, "_asked"), allowMissingColumns=True).unionByName(mark(floor, "_floor"), allowMissingColumns=True)
    same, record = Window.partitionBy("record_id", "encoded_path"), Window.partitionBy("record_id")
    any_ = lambda name: F.coalesce(F.max(name).over(same), F.lit(False))
    marked = both.repartition("record_id").select("*", any_("_leaf").alias("_is"), any_("_asked").alias("_shown"), any_("_floor").alias("_must"))
    unknown, below = F.col("_shown") & ~F.col("_is"), F.col("_must") & ~F.col("_shown")
    paths = lambda which: marked.filter(which).select("record_id", "encoded_path").distinct()
    good = marked.withColumn("_refused", F.max(unknown | below).over(record)).filter("_leaf and not _refused")
    kept = [c for c in leaves.columns if c not in ("record_id", "encoded_path", "leaf_hash")]
    shown = audit_paths(good, ordering, *kept, only="_shown")
    return shown.withColumn("display_path", display_path(F.col("path"))), paths(unknown), paths(below)


def verify_leaves(shown: DataFrame, ordering: str = "path") -> DataFrame:
    """shown (path parts, tag, carrier, salt, leaf_index, leaf_count, audit_path, root) with ``proven``. The leaf's hash is
    always computed here; one that a caller brings is never taken."""
    value = encode_value(F.col("tag"), F.col("carrier"))
    leaf = merkle.leaf_hash(F.col("encoded_path"), F.col("tag"), value, F.col("salt"), ordering)
    return shown.withColumn("proven", merkle.verify_inclusion(leaf, F.col("leaf_index"), F.col("leaf_count"), F.col("audit_path"), F.col("root")))

"""Issuing full copies, and making disclosed ones from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions import merkle, whole
from leafmill.operators import leaves as L
from leafmill.operators.verify import BATCH, Verifier, binder
from leafmill.sources import envelopes as E
from leafmill.sources.records import Rejected, decoded, parse, walk


def issue_full(records: DataFrame, typed: DataFrame, salts: DataFrame, ordering: str = "path", ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(envelopes: record_id, envelope_json; refused: record_id, reason). records: record_id, record_json, the identity
    (leaves.IDENTITY) and type_map_version; typed: their leaves; salts: drawn and stored before (leaves.draw_salts).

    A record that isn't bound to an exact map, id and version, is refused; neither is ever guessed.
    """
    unbound = F.col("type_map_id").isNull() | F.col("type_map_version").isNull()
    rows, roots = L.commit(records.filter(~unbound), typed.join(records.filter(~unbound).select("record_id"), "record_id", "left_semi"), salts, ordering, ascii_only)
    headers = records.withColumn("ordering", F.lit(ordering if ordering != "path" else None).cast("string"))
    refused = roots.filter("reason is not null").select("record_id", "reason").unionByName(records.filter(unbound).select("record_id", F.lit("envelope-malformed").alias("reason")))
    return E.write_full(rows, roots, headers), refused


def issue_records(records: DataFrame, config: Verifier) -> DataFrame:
    """record_id, envelope_json, reason (one of both is null) of records held whole: record_id, record_json, the identity,
    type_map_version, salts (array of encoded_path and salt: drawn and stored before), and if there identity_id.

    Each record is read, bound, hashed and written where it is; nothing is shuffled. As in ``issue_full``, a record that isn't
    bound to an exact map is refused.
    """
    merkle.domain(config.ordering)
    names = [*L.IDENTITY, "type_map_version"]
    own_id = F.col("identity_id" if "identity_id" in records.columns else "record_id").cast("string")
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), "record_json", "salts", own_id.alias("own_id"), *names)
    bound, ordering = binder(config), config.ordering

    def one(text, salts, *identity):
        own = whole.normal_identity(dict(zip(["record_id", *names], identity, strict=True)))
        if any(own[name] is None for name in (*_NEEDED, "type_map_id", "type_map_version")):
            return None, "envelope-malformed"
        try:
            if text is None:
                return None, "json-syntax"
            text = decoded(text)
            leaves = [(path, bound(path, kind, own), kind, literal) for path, kind, literal in walk(parse(text))]
            by_path: dict[bytes, bytes] = {}
            for path, salt in salts or ():
                by_path[path] = max(salt or b"", by_path.get(path, b""))
            made = whole.commit(own, leaves, lambda encoded, _: by_path.get(encoded), ordering)
            return (None, made.reason) if made.reason else (whole.full_copy(own, made, text, ordering), None)
        except Rejected as e:
            return None, str(e)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                columns = [_listed(part.column(n)) if n == 2 else part.column(n).to_pylist() for n in range(1, part.num_columns)]
                yield _answers(part.column(0), [one(*row) for row in zip(*columns, strict=True)])

    return rows.mapInArrow(run, _ANSWER)


_NEEDED = ("record_type", "schema_version", "record_id", "issuer_id")
_ANSWER = "record_id string, envelope_json string, reason string"


def _answers(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([e for e, _ in made], pa.string()), pa.array([r for _, r in made], pa.string())], ["record_id", "envelope_json", "reason"])


def _listed(column: pa.Array) -> list[list[tuple]]:
    """Lists of structs as lists of tuples, through one flat list for each member."""
    column = pa.concat_arrays([column])  # a slice's offsets start anywhere
    flat = column.flatten()
    items = list(zip(*[x.to_pylist() for x in flat.flatten()], strict=True))
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()]).tolist()
    return [items[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def disclose_tables(records: DataFrame, name: str, tags: dict[str, int], shown: Callable[[whole.Path], bool], salts: Callable[[str, str], bytes] | None = None, ordering: str = "path", even_bare: bool = False) -> DataFrame:
    """record_id, envelope_json, reason (one of both is null): disclosed copies of records that are rows of a table: record_id,
    the identity, rows (array of structs, in order), salts (array of encoded_path and salt).

    Leaves stand at name[index].column for the columns that tags names; a null cell is a NULL leaf. shown: of the own leaves'
    paths, which are shown; the reserved ones always are. salts: for tests, a function of record id and display path in place
    of the column. even_bare: also make copies of records without rows, which no verifier accepts.
    """
    merkle.domain(ordering)
    if bad := [f.name for f in records.schema["rows"].dataType.elementType if f.name in tags and f.dataType.typeName() in ("float", "double")]:
        raise ValueError(f"float-column: {bad}")
    cells = F.transform("rows", lambda r: F.struct(*[r[c].cast("string").alias(c) for c in tags]))
    stored = F.lit(None).cast("array<struct<encoded_path:binary,salt:binary>>") if salts else F.col("salts")
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), cells.alias("rows"), stored.alias("salts"), *L.IDENTITY)
    columns = [(c, tag, C.TAG_KINDS[tag]) for c, tag in tags.items()]
    told: dict[whole.Path, bool] = {}

    def visible(_, path):
        if path not in told:
            if len(told) >= 4096:
                told.clear()
            told[path] = isinstance(path[0], str) and path[0].startswith(C.RESERVED_PREFIX) or shown(path)
        return told[path]

    def one(record_id, lines, stored, *identity):
        own = whole.normal_identity(dict(zip(L.IDENTITY, identity, strict=True)) | {"record_id": record_id})
        if any(own[n] is None for n in _NEEDED):
            return None, "envelope-malformed"
        leaves = [((name, i, c), C.NULL, "null", None) if v is None else ((name, i, c), tag, kind, v) for i, line in enumerate(lines) for (c, tag, kind), v in zip(columns, line, strict=True)]
        by_path = dict(stored)
        salt_of = (lambda _, path: salts(record_id, whole.described(path)[1])) if salts else lambda encoded, _: by_path.get(encoded)
        made = whole.commit(own, leaves, salt_of, ordering)
        if made.root is None or made.reason and not even_bare:
            return None, made.reason
        return whole.disclosed_copy(own, made, visible, ordering), None

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                columns = [_listed(part.column(n)) if n in (1, 2) else part.column(n).to_pylist() for n in range(part.num_columns)]
                yield _answers(part.column(0), [one(*row) for row in zip(*columns, strict=True)])

    return rows.mapInArrow(run, _ANSWER)


def downgraded(envelopes: DataFrame, config: Verifier) -> DataFrame:
    """record_id, envelope_json, reason (one of both is null): disclosed copies of full ones: envelope_id, envelope_json,
    reveal (array of the encoded paths to show).

    A full copy is rebuilt once, under its own salts, and must give its root; its header comes from the leaves it
    commits. A copy that would leave out what the profile must show, or that asks for a leaf which isn't there, isn't made.
    """
    merkle.domain(config.ordering)
    bound, ordering = binder(config), config.ordering
    profiles = {t: {whole.encode_path(tuple(keys)) for keys in floor} for t, floor in (C.PROFILE_FLOORS if config.profiles is None else config.profiles).items()}
    always = {whole.encode_path((key,)) for key in (C.RECORD_TYPE, C.SCHEMA_VERSION, C.RECORD_ID, C.ISSUER_ID, *([C.ORDERING] if ordering != "path" else []))}
    by_map = whole.encode_path((C.TYPE_MAP_ID,))

    def one(text, reveal):
        try:
            row = E.read_one(text)
            if "leaves" in row:
                return None, "envelope-copy-kind"
            if row["record_type"] not in profiles:
                return None, "profile-unknown"
            if row.get("record_reason"):
                return None, row["record_reason"]
            made = whole.rebuild(row, bound, ordering)
            if made.reason or made.root != row["root"]:
                return None, made.reason or "root-mismatch"
            asked, there = set(reveal or ()), {x[0] for x in made.leaves}
            must = always | profiles[row["record_type"]] | ({by_map} if row["type_map_id"] is not None else set())
            if not asked <= there:
                return None, "envelope-malformed"
            if not must <= asked:
                return None, "minimum-disclosure-floor"
            return whole.disclosed_copy(whole.normal_identity(row), made, lambda encoded, _: encoded in asked, ordering), None
        except Rejected as e:
            return None, str(e)
        except UnicodeEncodeError:
            return None, "unpaired-surrogate"

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                yield _answers(part.column(0), [one(*row) for row in zip(*[part.column(n).to_pylist() for n in (1, 2)], strict=True)])

    return envelopes.select(F.col("envelope_id").cast("string").alias("record_id"), "envelope_json", "reveal").mapInArrow(run, _ANSWER)


def downgrade(envelopes: DataFrame, reveal: DataFrame, config: Verifier, work: str) -> tuple[DataFrame, DataFrame]:
    """(disclosed copies: record_id, envelope_json; refused: record_id, reason) of full copies (envelope_id, envelope_json), as
    ``downgraded`` makes them, stored once. reveal: record_id (the envelope's id) and encoded_path. work: a new folder that
    all executors see."""
    asked = reveal.groupBy(F.col("record_id").cast("string").alias("envelope_id")).agg(F.collect_set("encoded_path").alias("reveal"))
    downgraded(envelopes.withColumn("envelope_id", F.col("envelope_id").cast("string")).join(asked, "envelope_id", "left"), config).write.option("compression", "zstd").parquet(f"{work}/made")
    made = envelopes.sparkSession.read.parquet(f"{work}/made")
    return made.filter("reason is null").select("record_id", "envelope_json"), made.filter("reason is not null").select("record_id", "reason")


def value_rules(leaves: DataFrame, rules: Sequence[tuple[str, Sequence[str | None], str, str]]) -> DataFrame:
    """record_id, rule, reason of leaves that a profile's rule refuses. leaves: record_id, record_type, path, tag, carrier.
    rules: record type, path (None: any index), the rule's name, and the pattern that a canonical integer must fit."""
    refused = F.lit(None).cast("struct<rule:string,reason:string>")
    for record_type, path, name, pattern in rules:
        at = (F.col("record_type") == record_type) & (F.size("path") == len(path))
        for i, key in enumerate(path):
            at = at & (F.get("path", F.lit(i))["index"].isNotNull() if key is None else F.get("path", F.lit(i))["key"].eqNullSafe(F.lit(key)))
        fits = (F.col("tag") == C.INTEGER) & F.col("carrier").rlike(rf"\A(?:{pattern})\z")
        why = F.struct(F.lit(name).alias("rule"), F.when(F.col("tag") != C.INTEGER, F.lit("value-type-mismatch")).otherwise(F.lit("value-rule")).alias("reason"))
        refused = F.when(at & ~F.coalesce(fits, F.lit(False)), why).otherwise(refused)
    return leaves.withColumn("_r", refused).filter("_r is not null").select("record_id", "path", "_r.rule", "_r.reason")


def shared_salts(salts: DataFrame) -> DataFrame:
    """Salts (issuance, record_id, encoded_path, salt) that occur more than once, in one issuance or in several: salt, times,
    issuances. There must be none: a salt that returns links two leaves."""
    return salts.groupBy("salt").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("issuance").alias("issuances")).filter("times > 1")


def tally(results: DataFrame, by: str, passed: Column) -> DataFrame:
    """How many results of each class there are, and how many passed."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"))


def differences(found: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extra rows, missing rows), as often as they are too many or too few."""
    return found.exceptAll(wanted.select(*found.columns)), wanted.select(*found.columns).exceptAll(found)

"""Envelopes: full and disclosed copies as JSON text, to typed rows and back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.binary import to_hex
from leafmill.functions.identifiers import fits
from leafmill.functions.paths import known_path
from leafmill.sources.records import Rejected, _Number, decoded, kind, parse, segments, walk, write

# The members that each object of an envelope may have, and names that a salt's seed would go by.
TOP = {"canon", "hashAlg", "ordering", "recordType", "schemaVersion", "typeMap", "recordId", "root", "leafCount", "issuer", "anchor", "disclosure", "record", "salts"}
MEMBERS = {"typeMap": {"id", "version"}, "issuer": {"id", "keyId"}, "anchor": {"chainId", "registry", "txHash", "anchoredAt"}, "disclosure": {"mode", "leaves"}}
LEAF, SALT, SEGMENT = {"segments", "displayPath", "index", "tag", "value", "salt", "auditPath"}, {"segments", "salt"}, {"key", "index"}
SEEDS = {"masterSalt", "masterSaltHex", "seed", "saltSeed", "kdfKey"}

_PATH = pa.list_(pa.struct([("key", pa.string()), ("index", pa.int64())]))
_OWN = pa.list_(pa.struct([("path", _PATH), ("json_kind", pa.string()), ("literal", pa.string())]))
_SALTS = pa.list_(pa.struct([("path", _PATH), ("salt", pa.binary())]))
_LEAVES = pa.list_(pa.struct([("path", _PATH), ("index", pa.int64()), ("tag", pa.int32()), ("value", pa.string()), ("salt", pa.binary()), ("audit_path", pa.list_(pa.binary()))]))
_TEXTS = ["envelope_id", "reason", "canon", "hash_alg", "record_type", "schema_version", "record_id", "type_map_id", "type_map_version", "issuer_id", "issuer_key_id", "ordering", "registry", "record_json"]
_SCHEMA = pa.schema([*((n, pa.string()) for n in _TEXTS), ("root", pa.binary()), ("leaf_count", pa.int64()), ("chain_id", pa.int64()), ("record_reason", pa.string()), ("own", _OWN), ("salts", _SALTS), ("leaves", _LEAVES)])
_SQL = (
    ", ".join(f"{n} string" for n in _TEXTS)
    + f", root binary, leaf_count long, chain_id long, record_reason string, own array<struct<path:{C.PATH_TYPE},json_kind:string,literal:string>>, salts array<struct<path:{C.PATH_TYPE},salt:binary>>"
    + f", leaves array<struct<path:{C.PATH_TYPE},index:bigint,tag:int,value:string,salt:binary,audit_path:array<binary>>>"
)


_HEX = re.compile("[0-9a-f]*").fullmatch


def _need(ok: bool, reason: str = "envelope-malformed") -> None:
    if not ok:
        raise Rejected(reason)


def _text(x) -> str:
    # The parser makes plain strings, and numbers of a class of their own.
    if type(x) is not str:
        raise Rejected("envelope-malformed")
    return x


def _whole(x, most: int = 2**53) -> int:
    _need(isinstance(x, _Number) and x.isascii() and x.isdigit() and (x == "0" or x[0] != "0") and len(x) <= 16 and int(x) <= most)
    return int(x)


def _bytes(x, size: int | None = None) -> bytes:
    s = _text(x)
    if len(s) % 2 or not _HEX(s) or size is not None and len(s) != 2 * size:
        raise Rejected("envelope-malformed")
    return bytes.fromhex(s)


def _segments(x) -> tuple[str | int, ...]:
    _need(isinstance(x, list))
    out: list[str | int] = []
    for s in x:
        if type(s) is not dict or len(s) != 1:
            raise Rejected("envelope-malformed")
        out.append(_text(s["key"]) if "key" in s else _whole(s.get("index"), C.MAX_INDEX))
    return tuple(out)


def _strangers(doc: dict):
    """Members that no object of the envelope has; the record is the issuer's own and isn't looked into."""
    yield from set(doc) - TOP
    for name, known in MEMBERS.items():
        if isinstance(doc.get(name), dict):
            yield from set(doc[name]) - known
    disclosure = doc.get("disclosure")
    lists = [(disclosure.get("leaves") if isinstance(disclosure, dict) else None, LEAF), (doc.get("salts"), SALT)]
    for items, known in lists:
        for x in items if isinstance(items, list) else []:
            if isinstance(x, dict):
                if not x.keys() <= known:
                    yield from set(x) - known
                for s in x["segments"] if isinstance(x.get("segments"), list) else []:
                    if isinstance(s, dict) and not s.keys() <= SEGMENT:
                        yield from set(s) - SEGMENT


def _anchor(x) -> dict:
    _need(isinstance(x, dict) and fits("registry", x.get("registry")) and "chainId" in x)
    _need("txHash" not in x or fits("transaction", x["txHash"]))
    _need("anchoredAt" not in x or fits("date_time", x["anchoredAt"]))
    return {"registry": _text(x["registry"]), "chain_id": _whole(x["chainId"])}


def _row(doc) -> dict:
    """own: path, kind, literal; salts: path, salt; leaves: path, index, tag, value, salt, audit path."""
    _need(isinstance(doc, dict))
    strangers = set(_strangers(doc))
    _need(not strangers & SEEDS, "master-salt-in-envelope")
    _need(not strangers)
    full, shown = "record" in doc, "disclosure" in doc
    _need(full != shown, "envelope-copy-kind")
    _need(not (shown and "salts" in doc), "disclosed-copy-carries-salts")
    _need(not full or "salts" in doc)
    issuer, type_map = doc.get("issuer"), doc.get("typeMap")
    _need(isinstance(issuer, dict) and (type_map is None or isinstance(type_map, dict)))
    row = {"canon": _text(doc.get("canon")), "hash_alg": _text(doc.get("hashAlg")), "record_type": _text(doc.get("recordType")), "schema_version": _text(doc.get("schemaVersion")), "record_id": _text(doc.get("recordId"))}
    row |= {"issuer_id": _text(issuer.get("id")), "issuer_key_id": _text(issuer["keyId"]) if "keyId" in issuer else None, "type_map_id": _text(type_map.get("id")) if type_map else None}
    if type_map is not None:
        row["type_map_version"] = _text(type_map.get("version"))
        _need(fits("content_id", row["type_map_id"]) and fits("version", row["type_map_version"]))
    _need(fits("record_type", row["record_type"]) and fits("uri", row["issuer_id"]) and all(row[n] for n in ("schema_version", "record_id")))
    row["ordering"] = _text(doc["ordering"]) if "ordering" in doc else None
    row |= _anchor(doc["anchor"]) if "anchor" in doc else {}
    row |= {"root": _bytes(doc.get("root"), 32), "leaf_count": _whole(doc.get("leafCount"))}
    # The mandatory reserved leaves and one of the record's own; a key or a map adds one.
    _need(row["leaf_count"] >= 5 + ("keyId" in issuer or type_map is not None))
    if full:
        _need(isinstance(doc["salts"], list))
        row["salts"] = [(_segments(x.get("segments")), _bytes(x.get("salt"))) for x in doc["salts"]]
        try:
            row["record_json"] = write(doc["record"])
            row["own"] = list(walk(doc["record"]))
        except Rejected as e:
            row["record_reason"] = str(e)
        return row
    disclosure = doc["disclosure"]
    _need(isinstance(disclosure, dict) and disclosure.get("mode") == "selective" and isinstance(disclosure.get("leaves"), list))
    out = []
    for x in disclosure["leaves"]:
        _need(isinstance(x, dict) and isinstance(x.get("auditPath"), list))
        v = x.get("value")
        if "value" in x and type(v) is not str:
            _need(isinstance(v, bool), "value-type-mismatch")
            v = str(v).lower()
        out.append((_segments(x.get("segments")), _whole(x.get("index")), _whole(x.get("tag"), 255), v, _bytes(x.get("salt")), [_bytes(h, 32) for h in x["auditPath"]]))
    row["leaves"] = out
    return row


_PARTS = {"own": ("json_kind", "literal"), "salts": ("salt",), "leaves": ("index", "tag", "value", "salt", "audit_path")}


def read_one(text: str | bytes | None) -> dict:
    """The members of an envelope. Raises Rejected with a reason code."""
    _need(text is not None)
    return _row(parse(decoded(text)))


def read_envelopes(envelopes: DataFrame) -> DataFrame:
    """envelopes: envelope_id, envelope_json. One typed row each; ``reason`` says why one can't be read. A full copy has
    own (its record's leaves) and salts, a disclosed one leaves."""

    def run(batches):
        for batch in batches:
            rows = []
            for envelope_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(_SCHEMA.names)
                try:
                    row |= read_one(text)
                    for part, names in _PARTS.items():
                        if row[part] is not None:
                            row[part] = [{"path": segments(p), **dict(zip(names, more, strict=True))} for p, *more in row[part]]
                except Rejected as e:
                    row["reason"] = str(e)
                rows.append(row | {"envelope_id": envelope_id})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return envelopes.select(F.col("envelope_id").cast("string").alias("envelope_id"), "envelope_json").mapInArrow(run, _SQL)


def headers_of(leaves: DataFrame) -> DataFrame:
    """The identity of each record from its committed reserved leaves, whatever a holder's copy says: record_id (of the
    rows), identity_id (as committed) and the other members."""
    named = {"identity_id": C.RECORD_ID, "record_type": C.RECORD_TYPE, "schema_version": C.SCHEMA_VERSION, "type_map_id": C.TYPE_MAP_ID, "issuer_id": C.ISSUER_ID, "issuer_key_id": C.ISSUER_KEY_ID, "ordering": C.ORDERING}
    reserved = leaves.filter("reserved")
    return reserved.groupBy("record_id").agg(*[F.max(F.when(F.col("encoded_path") == known_path([key]), F.col("carrier"))).alias(name) for name, key in named.items()])


def _head(df: DataFrame) -> Column:
    """The opening of an envelope, without its closing brace, from identity, root and n."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    type_map = F.when(F.col("type_map_id").isNotNull(), F.struct(F.col("type_map_id").alias("id"), has("type_map_version").alias("version")))
    record_id = F.coalesce(has("identity_id"), F.col("record_id"))
    head = F.to_json(F.struct(F.lit(C.CANON).alias("canon"), F.lit(C.HASH_ALG).alias("hashAlg"), F.col("record_type").alias("recordType"), F.col("schema_version").alias("schemaVersion"), type_map.alias("typeMap"), has("ordering").alias("ordering"), record_id.alias("recordId"), to_hex(F.col("root")).alias("root"), F.col("n").alias("leafCount"), F.struct(F.col("issuer_id").alias("id"), F.col("issuer_key_id").alias("keyId")).alias("issuer")))
    return F.substr(head, F.lit(1), F.length(head) - 1)


def _segments_json(p: Column) -> Column:
    return F.transform(p, lambda s: F.struct(s["key"].alias("key"), s["index"].alias("index")))


def write_disclosed(shown: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, envelope_json) from disclosed leaves (operators.leaves.disclose) and headers: record_id, record_type,
    schema_version, type_map_id, issuer_id, issuer_key_id, and if there type_map_version, ordering and identity_id.
    Members without value are left out."""
    no_value = F.col("tag").isin(C.NULL, C.EMPTY_ARRAY, C.EMPTY_OBJECT)
    text = F.to_json(F.struct(_segments_json(F.col("path")).alias("segments"), F.col("display_path").alias("displayPath"), F.col("leaf_index").alias("index"), "tag", F.when(~no_value & (F.col("tag") != C.BOOL), F.col("carrier")).alias("value"), to_hex(F.col("salt")).alias("salt"), F.transform("audit_path", to_hex).alias("auditPath")))
    # A boolean is carried as one; to_json can't give a member two types.
    leaf = F.when(F.col("tag") == C.BOOL, F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"value":'), F.col("carrier"), F.lit("}"))).otherwise(text)
    items = shown.select("record_id", "leaf_index", "root", "leaf_count", leaf.alias("leaf")).groupBy("record_id").agg(F.first("root").alias("root"), F.first("leaf_count").alias("n"), F.array_sort(F.collect_list(F.struct("leaf_index", "leaf"))).alias("l"))
    r = items.join(headers, "record_id")
    body = F.concat(F.lit(',"disclosure":{"mode":"selective","leaves":['), F.array_join(F.transform("l", lambda x: x["leaf"]), ","), F.lit("]}}"))
    return r.select("record_id", F.concat(_head(r), body).alias("envelope_json"))


def write_full(leaves: DataFrame, roots: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, envelope_json): the record as it was written, and every leaf's salt. leaves and roots: of
    operators.leaves.commit; records: record_id, record_json and the members of a header."""
    salt = F.to_json(F.struct(_segments_json(F.col("path")).alias("segments"), to_hex(F.col("salt")).alias("salt")))
    salts = leaves.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("encoded_path", salt.alias("salt")))).alias("l"))
    r = salts.join(roots.filter("reason is null").select("record_id", "root", F.col("leaf_count").alias("n")), "record_id").join(records, "record_id")
    body = F.concat(F.lit(',"record":'), F.col("record_json"), F.lit(',"salts":['), F.array_join(F.transform("l", lambda x: x["salt"]), ","), F.lit("]}"))
    return r.select("record_id", F.concat(_head(r), body).alias("envelope_json"))


def read_salt_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by path, by place, refused) of salt sets as JSON text: set_id, salts_json. By path: record_id (the set's), path,
    salt; by place: record_id, pos, salt; refused: set_id, reason."""
    schema = pa.schema([("record_id", pa.string()), ("reason", pa.string()), ("path", _PATH), ("pos", pa.int64()), ("salt", pa.binary())])

    def rows(text):
        _need(text is not None)
        doc = parse(decoded(text))
        _need(isinstance(doc, dict) and isinstance(doc.get("salts"), list), "salts-malformed")
        if doc.get("pairing") == "path":
            _need(set(doc) == {"pairing", "salts"} and all(isinstance(x, dict) and set(x) == SALT for x in doc["salts"]), "salts-malformed")
            out = [(None, _segments(x["segments"]), None, _bytes(x["salt"], C.SALT_BYTES)) for x in doc["salts"]]
            _need(len({str(p) for _, p, _, _ in out}) == len(out), "salts-duplicate-path")
            return out
        _need(doc.get("pairing") == "positional" and set(doc) == {"pairing", "leafCount", "salts"}, "salts-malformed")
        _need(_whole(doc["leafCount"]) == len(doc["salts"]), "salts-length-not-leaf-count")
        return [(None, None, i, _bytes(x, C.SALT_BYTES)) for i, x in enumerate(doc["salts"])]

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for set_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [dict(zip(schema.names, (set_id, why, None if p is None else segments(p), *more), strict=True)) for why, p, *more in rows(text)]
                except Rejected as e:
                    out.append({"record_id": set_id, "reason": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema)

    read = sets.select(F.col("set_id").cast("string").alias("set_id"), "salts_json").mapInArrow(run, f"record_id string, reason string, path {C.PATH_TYPE}, pos long, salt binary")
    return read.filter("path is not null").select("record_id", "path", "salt"), read.filter("pos is not null").select("record_id", "pos", "salt"), read.filter("reason is not null").select(F.col("record_id").alias("set_id"), "reason")

"""Verification of envelopes: full copies are rebuilt, disclosed ones proved leaf by leaf. Every rejection has one reason,
the first in a fixed order: how the envelope is made, algorithm, profile, anchored root; then, of a full copy, its salts,
its record, its count and root; of a disclosed one, its leaves in their order, its identity, and what it must show."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from leafmill import constants as C
from leafmill.functions import merkle, whole
from leafmill.operators.typing import TypeMaps, tag_of
from leafmill.sources.envelopes import read_one
from leafmill.sources.records import Rejected
from leafmill.sources.type_maps import PatternMap

#: Envelopes that a task holds as Python objects at once.
BATCH = 1000


@dataclass
class Verifier:
    """What a verifier is configured with. Nothing of it is ever taken from an envelope."""

    profiles: dict[str, list[list[str]]] | None = None  #: record types and the paths they must show
    maps: TypeMaps | PatternMap | None = None  #: of full copies' records
    algorithms: tuple[str, ...] = (C.HASH_ALG,)
    ordering: str = "path"
    anchored: DataFrame | None = None  #: envelope_id, root, and if there hash_alg: what the registry records
    registry: str | None = None  #: address and chain that an envelope may name
    chain_id: int | None = None
    need_type_map: bool = False  #: refuse envelopes that aren't bound to an exact map
    empty_containers: str = "mechanical"  #: or map-authorized: empty containers and nulls only where the map binds them


def verify(envelopes: DataFrame, profiles: dict[str, list[list[str]]] | None = None, type_map: TypeMaps | PatternMap | None = None, ordering: str = "path", anchored: DataFrame | None = None, config: Verifier | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """envelope_id, accepted, reason, undischarged. envelopes: envelope_id, envelope_json. config, or its parts. keep: columns
    of envelopes that come along.

    undischarged: what this verifier wasn't in a position to check, by name. An envelope is read once and verified where it is
    read; only registered roots need a join.
    """
    v = config or Verifier(profiles, type_map, ordering=ordering, anchored=anchored)
    merkle.domain(v.ordering)
    rows = envelopes.select(F.col("envelope_id").cast("string").alias("envelope_id"), "envelope_json", *keep)
    if v.anchored is not None:
        alg = F.col("hash_alg") if "hash_alg" in v.anchored.columns else F.lit(None)
        rows = rows.join(v.anchored.select(F.col("envelope_id").cast("string").alias("envelope_id"), F.col("root").alias("_root"), alg.cast("string").alias("_alg")), "envelope_id", "left")
    else:
        rows = rows.withColumns({"_root": F.lit(None).cast("binary"), "_alg": F.lit(None).cast("string")})
    rows = rows.select("envelope_id", "envelope_json", "_root", "_alg", *keep)
    one = reason_of(v)
    kept = [f for f in rows.schema if f.name in keep]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                found = [one(*row) for row in zip(*[part.column(n).to_pylist() for n in (1, 2, 3)], strict=True)]
                reasons = pa.array([r for r, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), reasons.is_null(), reasons, pa.array([u for _, u in found], pa.list_(pa.string())), *[part.column(4 + n) for n in range(len(kept))]], ["envelope_id", "accepted", "reason", "undischarged", *[f.name for f in kept]])

    return rows.mapInArrow(run, StructType([StructField("envelope_id", StringType()), StructField("accepted", BooleanType()), StructField("reason", StringType()), StructField("undischarged", ArrayType(StringType())), *kept]))


def reason_of(v: Verifier) -> Callable[[str | bytes | None, bytes | None, str | None], tuple[str | None, list[str] | None]]:
    """(reason, undischarged) of an envelope's text, its registered root and algorithm."""
    algorithms = [a for a in v.algorithms if a == C.HASH_ALG]
    floors = {t: [whole.encode_path(tuple(keys)) for keys in floor] for t, floor in (C.PROFILE_FLOORS if v.profiles is None else v.profiles).items()}
    bound = binder(v)
    ordering, need_type_map, registry, chain_id, anchored = v.ordering, v.need_type_map, v.registry, v.chain_id, v.anchored is not None
    always = ([] if anchored and "hash_alg" in v.anchored.columns else ["algorithm-not-anchored"]) + ([] if anchored else ["root-not-anchored"])

    def head(row, root, alg) -> str | None:
        if row["canon"] != C.CANON:
            return "envelope-malformed"
        if row["hash_alg"] not in algorithms:
            return "hash-alg-not-allowed"
        if row["record_type"] not in floors:
            return "profile-unknown"
        if need_type_map and row["type_map_id"] is None:
            return "outer-identity-mismatch"
        if anchored and alg is not None and alg != row["hash_alg"]:
            return "hash-alg-not-allowed"
        if anchored and root != row["root"]:
            return "root-mismatch"
        if row.get("registry") is not None and (registry not in (None, row["registry"]) or chain_id not in (None, row["chain_id"])):
            return "envelope-malformed"
        return None

    def one(text, root, alg):
        try:
            row = read_one(text)
            full = "leaves" not in row
            reason = head(row, root, alg) or (whole.full_reason(row, bound, ordering) if full else whole.disclosed_reason(row, floors[row["record_type"]], ordering))
        except Rejected as e:
            return str(e), None
        except UnicodeEncodeError:
            return "unpaired-surrogate", None
        if reason:
            return reason, None
        return None, (["type-map-not-bound"] if row["type_map_id"] is None else []) + ([] if full else ["type-map-not-checked"]) + always

    return one


def binder(v: Verifier) -> Callable[[whole.Path, str, dict], int | None]:
    return tag_of(v.maps or None, v.empty_containers == "mechanical")

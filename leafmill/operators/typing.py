"""Binding leaves to tags. What no entry covers fails closed: nothing is guessed from a literal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.paths import shape
from leafmill.functions import whole
from leafmill.functions.text import nfc
from leafmill.sources.type_maps import Automaton, PatternMap, tokens


#: Maps by record type, schema version and content id (none where an envelope may go without).
TypeMaps = dict[tuple[str, str, str | None], PatternMap | Automaton]


def bind(leaves: DataFrame, maps: TypeMaps | PatternMap | Automaton) -> DataFrame:
    """leaves (path, json_kind, ...) with ``tag``, null where nothing binds it. With several maps, each leaf (record_type,
    schema_version, type_map_id) is bound by the one that is exactly its own; there is no other choice and no latest one."""
    if isinstance(maps, PatternMap):
        return by_patterns(leaves, maps)
    if isinstance(maps, Automaton):
        return leaves.withColumn("tag", walk_automaton(F.col("path"), F.col("json_kind"), maps))
    mine = lambda key: F.col("record_type").eqNullSafe(F.lit(key[0])) & F.col("schema_version").eqNullSafe(F.lit(key[1])) & F.col("type_map_id").eqNullSafe(F.lit(key[2]))
    patterns = [(key, m) for key, m in maps.items() if isinstance(m, PatternMap)]
    which = F.lit(None).cast("int")
    for i, (key, _) in enumerate(patterns):
        which = F.when(mine(key), F.lit(i)).otherwise(which)
    out = by_patterns(leaves.withColumn("_map", which), *[m for _, m in patterns]).drop("_map") if patterns else leaves.withColumn("tag", F.lit(None).cast("int"))
    for key, m in maps.items():
        if isinstance(m, Automaton):
            out = out.withColumn("tag", F.when(mine(key), walk_automaton(F.col("path"), F.col("json_kind"), m)).otherwise(F.col("tag")))
    return out


def by_patterns(leaves: DataFrame, *maps: PatternMap) -> DataFrame:
    """leaves (path, json_kind, ...) with ``tag``, null where no entry fits. Keys are compared in NFC. Of several maps, the
    one whose number is in the column _map counts.

    Patterns are compared once for each different shape, as equal keys: closed ones with the shape, open ones with its
    beginnings. Maps are metadata of a few thousand entries, whose size from_text fixes, so they are broadcast.
    """
    spark = leaves.sparkSession
    table = F.broadcast(reduce(DataFrame.unionByName, [m.table(spark).withColumn("m", F.lit(i)) for i, m in enumerate(maps)]))
    number = F.col("_map") if "_map" in leaves.columns else F.lit(0)
    shaped = leaves.withColumn("_shape", shape(F.col("path"))).withColumn("_m", number)
    kinds = shaped.select("_shape", "json_kind", "_m").distinct().withColumn("_normal", nfc(F.col("_shape")))
    parts = F.split("_normal", r"(?<!\\)/")
    begins = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = kinds.select("_shape", "_m", F.col("json_kind").alias("_kind"), F.explode(F.concat(F.array(F.struct(F.col("_normal").alias("s"), F.lit(False).alias("o"))), F.transform(begins, lambda b: F.struct(b.alias("s"), F.lit(True).alias("o"))))).alias("q"))
    found = asked.join(table, (F.col("q.s") == F.col("shape")) & (F.col("q.o") == F.col("open")) & (F.col("_m") == F.col("m")) & (F.col("json_kind").isNull() | (F.col("json_kind") == F.col("_kind"))))
    first = found.groupBy(F.col("_shape").alias("_at"), "_kind", F.col("_m").alias("_of")).agg(F.min_by("tag", "ordinal").alias("tag"))
    return shaped.join(first, (shaped["_shape"] == first["_at"]) & (shaped["json_kind"] == first["_kind"]) & (shaped["_m"] == first["_of"]), "left").drop("_shape", "_at", "_kind", "_m", "_of")


def tag_of(maps: TypeMaps | PatternMap | Automaton | None, mechanical: bool = True) -> Callable[[whole.Path, str, dict], int | None]:
    """What ``bind`` does, for one leaf in Python: a function of its path, JSON kind and record (record_type, schema_version,
    type_map_id). mechanical: empty containers and nulls are what they are, whatever the map."""
    many = maps if isinstance(maps, dict) else {None: maps}
    found = {key: _one(m) for key, m in many.items() if m is not None}
    mine = (lambda row: (row.get("record_type"), row.get("schema_version"), row.get("type_map_id"))) if isinstance(maps, dict) else lambda row: None
    empty = {"null": C.NULL, "array": C.EMPTY_ARRAY, "object": C.EMPTY_OBJECT} if mechanical else {}

    def tag(path: whole.Path, kind: str, row: dict) -> int | None:
        if kind in empty:
            return empty[kind]
        m = found.get(mine(row))
        return m(path, kind) if m else None

    return tag


def _one(m: PatternMap | Automaton) -> Callable[[whole.Path, str], int | None]:
    shaped = lambda path: tuple("." + whole.nfc(s).replace("\\", "\\\\").replace("/", "\\/") if isinstance(s, str) else "[*]" for s in path)
    if isinstance(m, Automaton):
        steps = m.steps()

        def walked(path, kind):
            state: int | None = m.start
            for s in shaped(path):
                if (state := steps.get(f"{state}{s}")) is None:
                    return None
            return m.bindings.get((state, kind))

        return walked
    entries: dict[tuple, list] = {}
    for i, (pattern, kind, tag) in enumerate(m.entries):
        t = tuple(tokens(pattern))
        at = (t[:-1], True) if t and t[-1] == "**" else (t, False)
        entries.setdefault(at, []).append((i, kind, tag))
    kept: dict[tuple, int | None] = {}

    def first(path, kind):
        if (path, kind) in kept:
            return kept[path, kind]
        s = shaped(path)
        fits = [x for at in ((s, False), *((s[:n], True) for n in range(max(len(s), 1)))) for x in entries.get(at, ()) if x[1] in (None, kind)]
        tag = min(fits, key=lambda x: x[0])[2] if fits else None
        if len(kept) < 4096 and sum(map(len, s)) <= 1024:
            kept[path, kind] = tag
        return tag

    return first


def walk_automaton(path: Column, json_kind: Column, automaton: Automaton) -> Column:
    """The tag at the end of an automaton's walk along path; null as soon as a transition is missing."""
    steps = F.create_map(*[F.lit(x) for kv in automaton.steps().items() for x in kv]) if automaton.steps() else F.create_map().cast("map<string,int>")
    tags = F.create_map(*[F.lit(x) for (s, k), t in automaton.bindings.items() for x in (f"{s} {k}", t)]) if automaton.bindings else F.create_map().cast("map<string,int>")
    segments = F.when(F.size(path) > 0, F.split(shape(path), r"(?<!\\)/")).otherwise(F.array().cast("array<string>"))
    state = F.aggregate(segments, F.lit(automaton.start), lambda s, x: F.try_element_at(steps, F.concat(s.cast("string"), x)))
    return F.try_element_at(tags, F.concat_ws(" ", F.when(state.isNotNull(), state.cast("string")).otherwise(F.lit("?")), json_kind))


def fail_closed(leaves: DataFrame) -> DataFrame:
    """The leaves without a tag."""
    return leaves.filter(F.col("tag").isNull())

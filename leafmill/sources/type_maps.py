"""Type maps: display-pattern files, and automata given as tables."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from leafmill import constants as C

_TOKEN = re.compile(r"\[(\*|[0-9]+)\]|([^.\[\]]+)")


def tokens(pattern: str) -> list[str]:
    """Segments of a pattern in the form of ``functions.paths.shape``: .key, or [*]."""
    out = []
    for m in _TOKEN.finditer(unicodedata.normalize("NFC", pattern)):
        key = m[2]
        out.append("[*]" if key is None else "**" if key == "**" else "." + key.replace("\\", "\\\\").replace("/", "\\/"))
    return out


@dataclass
class PatternMap:
    """Entries in order; the first that fits decides. A last ** stands for one or more segments."""

    entries: list[tuple[str, str | None, int]]  #: pattern, JSON kind (None: any), tag
    record_type: str = ""
    schema_version: str = ""
    map_id: str | None = None

    def __post_init__(self):
        for pattern, _, tag in self.entries:
            if tag not in C.TAG_KINDS or "**" in tokens(pattern)[:-1]:
                raise ValueError("type-map-rejected")

    @classmethod
    def from_text(cls, text: str) -> PatternMap:
        doc = json.loads(text)
        entries = [(e["pattern"], e.get("jsonKind"), int(e["tag"])) for e in doc["entries"]]
        return cls(entries, doc["recordType"], doc["schemaVersion"], doc.get("id"))

    def table(self, spark: SparkSession) -> DataFrame:
        """ordinal, shape, json_kind, tag, open (ends in **; the shape is what stands before)."""
        rows = []
        for i, (pattern, kind, tag) in enumerate(self.entries):
            t = tokens(pattern)
            is_open = bool(t) and t[-1] == "**"
            rows.append((i, "/".join(t[:-1] if is_open else t), kind, tag, is_open))
        return spark.createDataFrame(rows, "ordinal int, shape string, json_kind string, tag int, open boolean")


@dataclass
class Automaton:
    """A deterministic map: key and index transitions, and the tag that a state gives to a JSON kind."""

    start: int
    keys: dict[tuple[int, str], int]
    any_index: dict[int, int] = field(default_factory=dict)
    bindings: dict[tuple[int, str], int] = field(default_factory=dict)

    def __post_init__(self):
        for (_, kind), tag in self.bindings.items():
            if C.TAG_KINDS.get(tag) != kind:
                raise ValueError("type-map-rejected")

    def steps(self) -> dict[str, int]:
        """state and segment, as in a path's shape, to the next state."""
        escaped = lambda k: unicodedata.normalize("NFC", k).replace("\\", "\\\\").replace("/", "\\/")
        return {f"{s}.{escaped(k)}": t for (s, k), t in self.keys.items()} | {f"{s}[*]": t for s, t in self.any_index.items()}

"""Type-map artifacts: automata as files that are named by the hash of their exact bytes.

A map is metadata, some thousand states, so it is made and checked on the driver; leaves meet it as tables or as an
``Automaton`` (operators.typing).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leafmill import constants as C
from leafmill.functions.identifiers import fits
from leafmill.sources.records import Rejected, parse
from leafmill.sources.type_maps import Automaton, PatternMap

# The format's names, member sets, and how a binding may be founded.
FORMAT, REPRESENTATION, REGISTRY = "ROAX-TYPE-MAP/1", "structured-path-dfa/1", "ROAX-TYPE-MAP-REGISTRY/1"
NEEDED = {"format", "typeMapVersion", "recordType", "schemaVersion", "scope", "sourceSchemas", "extensionPoints", "addedSelectors", "coverage", "automaton"}
STATE = {"id", "keys", "anyIndex", "bindings", "unresolved", "structurallyUntypedObject"}
BASIS = {"schema-type", "schema-const", "schema-enum", "schema-container-type", "fhir-named-primitive", "fhir-element-name", "profile-ruling"}
COUNTS = ("states", "keyTransitions", "indexTransitions", "resolvedOutputs", "unresolvedOutputStates", "structurallyUntypedObjectStates")
KINDS = {"string", "number", "boolean", "null", "object", "array"}


def _need(ok: bool, reason: str = "type-map-rejected") -> None:
    if not ok:
        raise Rejected(reason)


def content_id(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(C.TYPE_MAP_DOMAIN + data).hexdigest()


def _utf8(s: str) -> bytes:
    return s.encode()


def _rising(items: list, key: Callable = _utf8) -> bool:
    keys = [key(x) for x in items]
    return all(a < b for a, b in zip(keys, keys[1:]))


def _row_key(row: dict) -> bytes:
    return json.dumps([row["jsonKinds"], row["reason"], row["sources"]], ensure_ascii=False, separators=(",", ":")).encode()


def _targets(state: dict) -> Iterator[str]:
    yield from (t["to"] for t in state.get("keys", []))
    if "anyIndex" in state:
        yield state["anyIndex"]


# ---- writing


def canonical(automaton: dict) -> dict:
    """The same automaton with states numbered as a breadth-first walk meets them, keys before the index, and every list
    in byte order. States that the start doesn't reach are left out."""
    states = {s["id"]: s for s in automaton["states"]}
    number, queue, out = {automaton["start"]: 0}, deque([automaton["start"]]), []
    while queue:
        s = states[queue.popleft()]
        keys = sorted(s.get("keys", []), key=lambda t: _utf8(t["key"]))
        for to in [*(t["to"] for t in keys), *([s["anyIndex"]] if "anyIndex" in s else [])]:
            if to not in number:
                number[to] = len(number)
                queue.append(to)
        row: dict = {"id": f"s{number[s['id']]}"}
        if keys:
            row["keys"] = [{"key": t["key"], "to": f"s{number[t['to']]}"} for t in keys]
        if "anyIndex" in s:
            row["anyIndex"] = f"s{number[s['anyIndex']]}"
        if s.get("bindings"):
            row["bindings"] = [b | {"basis": sorted(b["basis"], key=_utf8), "sources": sorted(b["sources"], key=_utf8)} for b in sorted(s["bindings"], key=lambda b: _utf8(b["jsonKind"]))]
        if s.get("unresolved"):
            row["unresolved"] = sorted(({"jsonKinds": sorted(u["jsonKinds"], key=_utf8), "reason": u["reason"], "sources": sorted(u["sources"], key=_utf8)} for u in s["unresolved"]), key=_row_key)
        if s.get("structurallyUntypedObject"):
            row["structurallyUntypedObject"] = True
        out.append(row)
    return {"representation": REPRESENTATION, "start": "s0", "states": out}


def summary(automaton: dict) -> dict:
    """How many states, transitions and outputs, and outputs by tag and by basis."""
    states = automaton["states"]
    bindings = [b for s in states for b in s.get("bindings", [])]
    counts = [len(states), sum(len(s.get("keys", [])) for s in states), sum("anyIndex" in s for s in states), len(bindings), sum("unresolved" in s for s in states), sum(bool(s.get("structurallyUntypedObject")) for s in states)]
    by = lambda values: {k: n for k, n in sorted(Counter(values).items())}
    return dict(zip(COUNTS, counts)) | {"byTag": by(str(b["tag"]) for b in bindings), "byBasis": by(x for b in bindings for x in b["basis"])}


def artifact(automaton: dict, record_type: str, schema_version: str, version: str, sources: list[dict], untyped_sources: int = 0, extension_points: list[dict] | None = None, parent: str | None = None, issuers: list[str] | None = None, added: list[dict] | None = None) -> dict:
    automaton = canonical(automaton)
    head = {"format": FORMAT, "typeMapVersion": version, "recordType": record_type, "schemaVersion": schema_version}
    if parent:
        head["parentTypeMapId"] = parent
    scope = {"kind": "issuers", "issuerIds": issuers} if issuers else {"kind": "profile"}
    counts = summary(automaton) | {"concretePathCardinality": "infinite", "structurallyUntypedObjectSourceNodes": untyped_sources, "notes": []}
    return head | {"scope": scope, "sourceSchemas": sources, "extensionPoints": extension_points or [], "addedSelectors": added or [], "coverage": counts, "automaton": automaton}


def write(doc: dict) -> bytes:
    """The exact bytes that an artifact is published as."""
    return (json.dumps(doc, ensure_ascii=False, indent=2) + "\n").encode()


# ---- reading


@dataclass(frozen=True)
class Artifact:
    id: str
    doc: dict

    @property
    def triple(self) -> tuple[str, str, str]:
        return self.doc["recordType"], self.doc["schemaVersion"], self.id

    @property
    def version(self) -> str:
        return self.doc["typeMapVersion"]

    def automaton(self) -> Automaton:
        number = {s["id"]: i for i, s in enumerate(self.doc["automaton"]["states"])}
        keys, index, bindings = {}, {}, {}
        for s in self.doc["automaton"]["states"]:
            n = number[s["id"]]
            keys |= {(n, t["key"]): number[t["to"]] for t in s.get("keys", [])}
            bindings |= {(n, b["jsonKind"]): b["tag"] for b in s.get("bindings", [])}
            if "anyIndex" in s:
                index[n] = number[s["anyIndex"]]
        return Automaton(number[self.doc["automaton"]["start"]], keys, index, bindings)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Key transitions, index transitions and outputs, a row each."""
        a = self.automaton()
        return (
            spark.createDataFrame([(self.id, s, k, t) for (s, k), t in a.keys.items()], "map_id string, state int, key string, next int"),
            spark.createDataFrame([(self.id, s, t) for s, t in a.any_index.items()], "map_id string, state int, next int"),
            spark.createDataFrame([(self.id, s, k, t) for (s, k), t in a.bindings.items()], "map_id string, state int, json_kind string, tag int"),
        )


def _numbers(node):
    """The document with whole numbers as such; any other number is refused."""
    if isinstance(node, dict):
        return {k: _numbers(v) for k, v in node.items()}
    if isinstance(node, list):
        return [_numbers(v) for v in node]
    if isinstance(node, str) and type(node) is not str:
        _need(node.isascii() and node.isdigit() and (node == "0" or node[0] != "0"))
        return int(node)
    return node


def load(data: bytes, expected_id: str, issuer_children: bool = False) -> Artifact:
    """An artifact from its exact bytes. Raises Rejected: type-map-id-mismatch, type-map-rejected or blob-ref-not-selectable.
    A child for issuers is loaded only where the caller checks it against its parent (``check_extension``)."""
    _need(content_id(data) == expected_id, "type-map-id-mismatch")
    try:
        doc = _numbers(parse(data.decode()))
    except UnicodeDecodeError:
        raise Rejected("json-syntax") from None
    _check_head(doc)
    _need(issuer_children or "parentTypeMapId" not in doc)
    sources = _check_sources(doc["sourceSchemas"])
    _check_states(doc["automaton"], sources)
    _check_selectors(doc, sources)
    want = summary(doc["automaton"])
    got = doc["coverage"]
    _need(isinstance(got, dict) and got.get("concretePathCardinality") == "infinite" and {k: got.get(k) for k in want} == want and all(isinstance(n, str) and n for n in got.get("notes", [])))
    return Artifact(expected_id, doc)


def _check_head(doc) -> None:
    _need(isinstance(doc, dict) and NEEDED <= set(doc) <= NEEDED | {"parentTypeMapId"})
    _need(doc["format"] == FORMAT and fits("version", doc["typeMapVersion"]) and bool(doc["recordType"]) and bool(doc["schemaVersion"]))
    a, scope = doc["automaton"], doc["scope"]
    _need(isinstance(a, dict) and a.get("representation") == REPRESENTATION and a.get("start") == "s0" and isinstance(a.get("states"), list) and bool(a["states"]))
    if "parentTypeMapId" in doc:
        ids = scope.get("issuerIds") or []
        _need(fits("content_id", doc["parentTypeMapId"]) and scope.get("kind") == "issuers" and bool(ids) and all(ids) and len(set(ids)) == len(ids) and bool(doc["addedSelectors"]))
    else:
        _need(scope == {"kind": "profile"} and not doc["addedSelectors"])


def _check_sources(sources: list[dict]) -> set[str]:
    ids = [s.get("sourceId") for s in sources]
    _need(bool(ids) and all(isinstance(i, str) and i and "#" not in i for i in ids) and len(set(ids)) == len(ids))
    for s in sources:
        if s.get("kind") == "git":
            path = s.get("path", "")
            commit = s.get("commit", "")
            _need(fits("uri", s.get("repositoryUri")) and bool(path) and path[0] != "/" and ".." not in path.split("/") and len(commit) == 40 and set(commit) <= set("0123456789abcdef"))
        else:
            _need(s.get("kind") == "content" and fits("uri", s.get("uri")) and fits("content_id", s.get("digest")))
    return set(ids)


def _check_states(automaton: dict, sources: set[str]) -> None:
    states = automaton["states"]
    known = lambda refs: all(r.split("#", 1)[0] in sources for r in refs)
    met = 1
    for i, s in enumerate(states):
        _need(set(s) <= STATE and s.get("id") == f"s{i}" and s.get("structurallyUntypedObject", True) is True)
        _need(all(s[part] for part in ("keys", "bindings", "unresolved") if part in s))
        keys = [t["key"] for t in s.get("keys", [])]
        _need(_rising(keys) and all(unicodedata.is_normalized("NFC", k) for k in keys))
        for to in _targets(s):
            _need(to[:1] == "s" and to[1:].isdigit() and int(to[1:]) < len(states) and to == f"s{int(to[1:])}")
            # A breadth-first walk meets states in the order of their numbers.
            _need(int(to[1:]) <= met)
            met = max(met, int(to[1:]) + 1)
        bound = [b["jsonKind"] for b in s.get("bindings", [])]
        _need(_rising(bound))
        for b in s.get("bindings", []):
            _need(b["tag"] != C.BLOB_REF, "blob-ref-not-selectable")
            _need(C.TAG_KINDS.get(b["tag"]) == b["jsonKind"] and bool(b["basis"]) and bool(b["sources"]) and set(b["basis"]) <= BASIS)
            _need(_rising(b["basis"]) and _rising(b["sources"]) and known(b["sources"]))
        rows = s.get("unresolved", [])
        for u in rows:
            _need(bool(u["jsonKinds"]) and bool(u["reason"]) and _rising(u["jsonKinds"]) and set(u["jsonKinds"]) <= KINDS - set(bound) and _rising(u["sources"]) and known(u["sources"]))
        _need(_rising(rows, _row_key))
        # Whoever hasn't been met by the states before isn't reached at all.
        _need(i < met)
    _need(met == len(states))


def _segment(s: dict) -> tuple[str, str] | tuple[str]:
    _need(isinstance(s, dict) and len(s) == 1 and (s.get("anyIndex") is True or isinstance(s.get("key"), str) and unicodedata.is_normalized("NFC", s["key"])))
    return ("key", s["key"]) if "key" in s else ("index",)


def _step(state: dict, segment: tuple) -> str | None:
    if segment == ("index",):
        return state.get("anyIndex")
    return next((t["to"] for t in state.get("keys", []) if t["key"] == segment[1]), None)


def _check_selectors(doc: dict, sources: set[str]) -> None:
    states = {s["id"]: s for s in doc["automaton"]["states"]}
    prefixes = set()
    for point in doc["extensionPoints"]:
        prefix, at = tuple(map(_segment, point["prefix"])), "s0"
        for segment in prefix:
            at = _step(states[at], segment)
            _need(at is not None)
        _need(bool(point.get("note")) and prefix not in prefixes)
        prefixes.add(prefix)
    seen = set()
    for x in doc["addedSelectors"]:
        path = tuple(map(_segment, x["segments"]))
        _need(bool(path) and x["tag"] != C.BLOB_REF and C.TAG_KINDS.get(x["tag"]) == x["jsonKind"] and bool(x["evidence"]) and len(set(x["evidence"])) == len(x["evidence"]) and set(x["evidence"]) <= sources)
        _need((path, x["jsonKind"]) not in seen)
        seen.add((path, x["jsonKind"]))


# ---- extensions and registries


def check_extension(parent: Artifact, child: Artifact) -> list[str]:
    """Why a child isn't an additive extension of its parent; none if it is.

    Both automata are walked together with the tree of added selectors. Wherever the parent has a transition or an
    output, the child has the same; whatever else the child has must be on the way to, or be, an added selector; and each
    selector lies at an extension point: beyond what the parent declares there, or one step below it at a kind that the
    parent lists as unresolved.
    """
    p, c, why = parent.doc, child.doc, []
    for member in ("recordType", "schemaVersion"):
        if p[member] != c[member]:
            why.append(f"{member} differs")
    if c.get("parentTypeMapId") != parent.id:
        why.append("another parent")
    if p["scope"]["kind"] == "issuers" and not set(c["scope"].get("issuerIds", [])) <= set(p["scope"]["issuerIds"]):
        why.append("scope is wider than the parent's")
    if any(s not in c["sourceSchemas"] for s in p["sourceSchemas"]):
        why.append("a source of the parent is missing")
    if p["extensionPoints"] != c["extensionPoints"]:
        why.append("extension points differ")
    added: dict = {}
    for x in c["addedSelectors"]:
        added[tuple(map(_segment, x["segments"])), x["jsonKind"]] = x
    ways = {path[:k] for path, _ in added for k in range(len(path) + 1)}
    old, new = ({s["id"]: s for s in d["automaton"]["states"]} for d in (p, c))
    prefixes = [tuple(map(_segment, point["prefix"])) for point in p["extensionPoints"]]

    def at(path: tuple) -> tuple[dict | None, int]:
        """The parent's state at path, or none, and how far it declares the path."""
        s = "s0"
        for k, segment in enumerate(path):
            s = _step(old[s], segment)
            if s is None:
                return None, k
        return old[s], len(path)

    for (path, kind), x in added.items():
        state, declared = at(path)
        if state is None:
            # Beyond what is declared: the first undeclared step is right below an extension point.
            fine = any(path[:declared] == e for e in prefixes)
        else:
            gap = any(kind in u["jsonKinds"] for u in state.get("unresolved", []))
            fine = gap and any(path[:-1] == e for e in prefixes) and all(b["jsonKind"] != kind for b in state.get("bindings", []))
        if not fine:
            why.append(f"selector {len(path)} deep for {kind} isn't at an extension point")
    # Pairs of states, with the way to them only as long as a selector still lies ahead.
    queue, seen, found = deque([("s0", "s0", ())]), set(), set()
    while queue:
        a, b, way = queue.popleft()
        if (a, b, way) in seen:
            continue
        seen.add((a, b, way))
        s, t = old.get(a) if a else None, new[b]
        known = {x["jsonKind"]: x for x in s.get("bindings", [])} if s else {}
        for x in t.get("bindings", []):
            kind = x["jsonKind"]
            if kind in known:
                if known[kind] != x:
                    why.append(f"{a}: output for {kind} changed")
            elif way is not None and (way, kind) in added and added[way, kind]["tag"] == x["tag"] and set(added[way, kind]["evidence"]) <= {r.split("#", 1)[0] for r in x["sources"]}:
                found.add((way, kind))
            else:
                why.append(f"{b}: output for {kind} is no added selector")
        for kind in set(known) - {x["jsonKind"] for x in t.get("bindings", [])}:
            why.append(f"{a}: output for {kind} is missing")
        if s is not None:
            resolved = {k for w, k in added if w == way}
            left = [u | {"jsonKinds": [k for k in u["jsonKinds"] if k not in resolved]} for u in s.get("unresolved", [])]
            if [u for u in left if u["jsonKinds"]] != t.get("unresolved", []):
                why.append(f"{a}: unresolved rows changed")
        steps = [("key", x["key"]) for x in t.get("keys", [])] + ([("index",)] if "anyIndex" in t else [])
        for segment in steps:
            to = _step(s, segment) if s else None
            further = (*way, segment) if way is not None and (*way, segment) in ways else None
            if to is None and further is None:
                why.append(f"{b}: a transition leads to no added selector")
            else:
                queue.append((to, _step(t, segment), further))
        if s is not None:
            if any(_step(t, ("key", x["key"])) is None for x in s.get("keys", [])) or "anyIndex" in s and "anyIndex" not in t:
                why.append(f"{a}: a transition is missing")
    why += [f"selector for {kind} has no output" for _, kind in sorted(set(added) - found, key=str)]
    return why


def check_registry(registry: dict, files: dict[str, bytes]) -> list[str]:
    """Why a registry of maps can't be trusted; none if it can. files: path to exact bytes."""
    why = []
    if registry.get("format") != REGISTRY or not fits("version", registry.get("registryVersion")) or registry.get("idAlgorithm", {}).get("name") != "sha256":
        why.append("registry head")
    maps = registry.get("maps", [])
    for member in ("id", "path"):
        if len({m.get(member) for m in maps}) < len(maps):
            why.append(f"{member} twice")
    if len({(m.get("recordType"), m.get("schemaVersion"), m.get("typeMapVersion"), json.dumps(m.get("scope"), sort_keys=True)) for m in maps}) < len(maps):
        why.append("the same map twice")
    for m in maps:
        data = files.get(m.get("path"))
        if data is None:
            why.append(f"{m.get('path')}: no such file")
            continue
        try:
            a = load(data, m["id"], issuer_children=True)
        except Rejected as e:
            why.append(f"{m['path']}: {e}")
            continue
        why += [f"{m['path']}: {n} differs" for n in ("recordType", "schemaVersion", "typeMapVersion", "scope") if a.doc[n] != m.get(n)]
    return why


# ---- compiling JSON Schemas


class Schemas:
    """JSON Schema documents by name. A node is known by its document and its place there."""

    def __init__(self, documents: dict[str, dict]):
        self.documents = documents

    def at(self, name: str, pointer: str) -> dict:
        node = self.documents[name]
        for part in pointer.split("/")[1:]:
            part = part.replace("~1", "/").replace("~0", "~")
            node = node[int(part)] if isinstance(node, list) else node[part]
        return node

    def target(self, name: str, ref: str) -> tuple[str, str]:
        document, _, pointer = ref.partition("#")
        return (document or name), pointer.rstrip("/")

    def alternatives(self, nodes: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """What nodes stand for when references are followed and unions opened, in byte order."""
        found, seen, stack = [], set(), list(nodes)
        while stack:
            place = stack.pop()
            if place in seen:
                continue
            seen.add(place)
            node = self.at(*place)
            if not isinstance(node, dict):
                continue
            if isinstance(node.get("$ref"), str):
                stack.append(self.target(place[0], node["$ref"]))
                continue
            if "allOf" in node:
                raise Rejected("schema-intersection")
            unions = [(place[0], f"{place[1]}/{word}/{i}") for word in ("anyOf", "oneOf") for i in range(len(node.get(word, [])))]
            if not unions or set(node) & {"type", "properties", "items", "enum", "const", "required", "minItems", "minProperties"}:
                found.append(place)
            stack += unions
        return sorted(found, key=lambda p: _utf8("#".join(p)))


#: What JSON Schema's words settle without doubt: kind, tag, basis. A number may be an integer or a decimal.
_TYPES = {"string": ("string", C.STRING), "boolean": ("boolean", C.BOOL), "null": ("null", C.NULL), "integer": ("number", C.INTEGER)}


def scalar(node: dict) -> tuple[str, int | None, str] | None:
    """(kind, tag, basis) that a schema node alone determines; tag None where the kind leaves the tag open."""
    if node.get("type") in _TYPES:
        return *_TYPES[node["type"]], "schema-type"
    if node.get("type") == "number":
        return "number", None, "JSON Schema's number is neither an integer nor a decimal."
    values = [node["const"]] if "const" in node else node.get("enum") or []
    kinds = {"string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "other" for v in values}
    if "type" not in node and len(kinds) == 1 and "other" not in kinds:
        return *_TYPES[kinds.pop()], "schema-const" if "const" in node else "schema-enum"
    return None


def compile_schema(documents: dict[str, dict], root: str, classify: Callable[[str, str, dict], tuple[str, int | None, str] | None] | None = None) -> tuple[dict, int]:
    """(automaton, how many source nodes lack type: object) of a JSON Schema, by subset construction: a state is the set of
    schema nodes that a path can reach. classify (document, pointer, node) may rule on what ``scalar`` leaves open.

    Raises Rejected where branches disagree on a tag or on emptiness, for allOf, and for names equal in NFC.
    """
    schemas = Schemas(documents)
    start = tuple(schemas.alternatives([(root, "")]))
    number, queue, states, untyped = {start: 0}, deque([start]), [], set()

    def state_of(nodes: list[tuple[str, str]]) -> str:
        s = tuple(schemas.alternatives(nodes))
        if s not in number:
            number[s] = len(number)
            queue.append(s)
        return f"s{number[s]}"

    def agreed(nodes: list[dict], empty: Callable[[dict], bool]) -> bool:
        answers = {empty(n) for n in nodes}
        if len(answers) > 1:
            raise Rejected("schema-branches-disagree")
        return answers == {True}

    while queue:
        places = queue.popleft()
        nodes = [(p, schemas.at(*p)) for p in places]
        row: dict = {"id": f"s{number[places]}"}
        tags: dict[str, dict[int, list[tuple[str, str]]]] = {}
        unresolved = []
        for p, node in nodes:
            ruled = (classify(*p, node) if classify else None) or scalar(node)
            if ruled and ruled[1] is None:
                unresolved.append({"jsonKinds": [ruled[0]], "reason": ruled[2], "sources": ["#".join(p)]})
            elif ruled:
                tags.setdefault(ruled[0], {}).setdefault(ruled[1], []).append((ruled[2], "#".join(p)))
        objects = [(p, n) for p, n in nodes if n.get("type") == "object" or "properties" in n]
        arrays = [(p, n) for p, n in nodes if n.get("type") == "array" or "items" in n]
        typed_arrays = [(p, n) for p, n in arrays if n.get("type") == "array"]
        loose = {p for p, n in objects if n.get("type") != "object"}
        untyped |= loose
        if objects and agreed([n for _, n in objects], lambda n: not n.get("required") and not n.get("minProperties")):
            tags["object"] = {C.EMPTY_OBJECT: [("schema-container-type", "#".join(p)) for p, _ in objects]}
        if arrays and agreed([n for _, n in arrays], lambda n: not n.get("minItems") and "contains" not in n) and typed_arrays:
            tags["array"] = {C.EMPTY_ARRAY: [("schema-container-type", "#".join(p)) for p, _ in typed_arrays]}
        open_kinds = {k for u in unresolved for k in u["jsonKinds"]}
        bindings = []
        for kind, found in tags.items():
            if kind in open_kinds:
                unresolved.append({"jsonKinds": [kind], "reason": "One branch settles the tag, another leaves it open.", "sources": []})
            elif len(found) > 1:
                raise Rejected("schema-branches-disagree")
            else:
                ((tag, evidence),) = found.items()
                bindings.append({"jsonKind": kind, "tag": tag, "basis": list({b for b, _ in evidence}), "sources": list({s for _, s in evidence})})
        below: dict[str, tuple[set[str], list]] = {}
        for p, n in objects:
            for name in n.get("properties", {}):
                names, places_ = below.setdefault(unicodedata.normalize("NFC", name), (set(), []))
                names.add(name)
                places_.append((p[0], f"{p[1]}/properties/{name.replace('~', '~0').replace('/', '~1')}"))
        if any(len(names) > 1 for names, _ in below.values()):
            raise Rejected("schema-names-equal-in-nfc")
        row["keys"] = [{"key": k, "to": state_of(below[k][1])} for k in sorted(below, key=_utf8)]
        items = [(p[0], f"{p[1]}/items") for p, n in typed_arrays if isinstance(n.get("items"), dict)]
        if items:
            row["anyIndex"] = state_of(items)
        row |= {"bindings": bindings, "unresolved": list({_row_key(u): u for u in unresolved}.values()), "structurallyUntypedObject": bool(loose)}
        states.append(row)
    return canonical({"start": "s0", "states": states}), len(untyped)


def derive_patterns(automaton: dict, paths: list[tuple[list[str | int], str]], rulings: dict[tuple[str, str], int] | None = None) -> tuple[PatternMap, list[tuple[str, str]]]:
    """(entries, what stays unbound) for the paths of a sample: the sample gives the paths, the schema's automaton every tag.
    A ruling may fill only what is unbound there; one for anything else is refused."""
    states = {s["id"]: s for s in automaton["states"]}
    entries, unbound = {}, {}
    for path, kind in paths:
        pattern, at = "", automaton["start"]
        for x in path:
            pattern += "[*]" if isinstance(x, int) else f".{x}" if pattern else x
            at = _step(states[at], ("index",) if isinstance(x, int) else ("key", unicodedata.normalize("NFC", x))) if at else None
        tag = next((b["tag"] for b in states[at].get("bindings", []) if b["jsonKind"] == kind), None) if at else None
        (unbound if tag is None else entries).setdefault((pattern, kind), tag)
    for where, tag in (rulings or {}).items():
        _need(where in unbound, "ruling-without-gap")
        del unbound[where]
        entries[where] = tag
    return PatternMap([(p, k, t) for (p, k), t in entries.items()]), list(unbound)

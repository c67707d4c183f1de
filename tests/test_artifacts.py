"""Type-map artifacts: compiled, written, loaded strictly, extended and registered."""

import copy
import json

import pytest

from leafmill.sources import artifacts as A
from leafmill.sources.records import Rejected

SCHEMA = {
    "r.json": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "é/~": {"enum": [True, False]}, "open": {"type": "number"}, "loose": {"properties": {"x": {"const": None}}}, "list": {"type": "array", "items": {"oneOf": [{"$ref": "t.json#/definitions/a"}, {"type": "string"}]}}}},
    "t.json": {"definitions": {"a": {"type": "object", "properties": {"b": {"type": "string"}, "again": {"$ref": "#/definitions/a"}}}}},
}
SOURCES = [{"sourceId": n, "kind": "content", "uri": f"https://a.b/{n}", "digest": "sha256:" + "0" * 64} for n in SCHEMA]


def _doc(**more):
    automaton, untyped = A.compile_schema(SCHEMA, "r.json")
    return A.artifact(automaton, "a.b", "1", "1.0.0", SOURCES, untyped, **more)


def _load(doc, **k):
    data = A.write(doc)
    return A.load(data, A.content_id(data), **k)


def test_compiled():
    a = _load(_doc())
    m = a.automaton()

    def tag(kind, *path):
        s = 0
        for x in path:
            s = m.any_index.get(s) if isinstance(x, int) else m.keys.get((s, x))
        return m.bindings.get((s, kind))

    assert [tag("number", "n"), tag("boolean", "é/~"), tag("number", "open"), tag("null", "loose", "x"), tag("string", "list", 0), tag("string", "list", 3, "again", "again", "b"), tag("object", "list", 1), tag("array", "list"), tag("object", "loose"), tag("object")] == [3, 1, None, 0, 2, 2, 7, 6, 7, None]
    assert a.triple == ("a.b", "1", a.id) and a.doc["coverage"]["unresolvedOutputStates"] == 1 and a.doc["coverage"]["structurallyUntypedObjectStates"] == 1
    assert A.write(a.doc | {"automaton": A.canonical(a.doc["automaton"])}) == A.write(a.doc)
    back = copy.deepcopy(a.doc["automaton"])
    for s in back["states"]:
        s.get("keys", []).reverse()
        s.get("bindings", []).reverse()
    assert A.canonical(back) == a.doc["automaton"]


@pytest.mark.parametrize("schema", [{"allOf": []}, {"oneOf": [{"type": "integer"}, {"type": "number"}]}, {"oneOf": [{"type": "object"}, {"type": "object", "required": ["a"]}]}, {"type": "object", "properties": {"\u00e9": {}, "e\u0301": {}}}])
def test_not_compiled(schema):
    if schema.get("oneOf", [{}])[0].get("type") == "integer":
        # Open in one branch: nothing is bound, nothing refused.
        assert "bindings" not in A.compile_schema({"x": schema}, "x")[0]["states"][0]
    else:
        with pytest.raises(Rejected):
            A.compile_schema({"x": schema}, "x")
    with pytest.raises(Rejected):
        A.compile_schema({"x": {"anyOf": [{"type": "string"}, {"const": "a"}, {"type": "boolean"}], "properties": {"a": {"oneOf": [{"type": "integer"}, {"const": 1}]}, "b": {"allOf": []}}}}, "x")


def _changed(change):
    doc = json.loads(A.write(_doc()))
    change(doc)
    return doc


CHANGES = {
    "format": lambda d: d.update(format="x"),
    "version": lambda d: d.update(typeMapVersion="1.0"),
    "stranger": lambda d: d.update(more=1),
    "coverage": lambda d: d["coverage"].update(states=1),
    "tags": lambda d: d["coverage"]["byTag"].update({"2": 9}),
    "order of keys": lambda d: d["automaton"]["states"][0]["keys"].reverse(),
    "numbering": lambda d: d["automaton"]["states"][0]["keys"][0].update(to="s2"),
    "target": lambda d: d["automaton"]["states"][0]["keys"][0].update(to="s99"),
    "unreached": lambda d: d["automaton"]["states"].append({"id": f"s{len(d['automaton']['states'])}"}),
    "empty list": lambda d: d["automaton"]["states"][1].update(keys=[]),
    "kind": lambda d: next(s for s in d["automaton"]["states"] if "bindings" in s)["bindings"][0].update(tag=5),
    "source": lambda d: next(s for s in d["automaton"]["states"] if "bindings" in s)["bindings"][0].update(sources=["q"]),
    "basis": lambda d: next(s for s in d["automaton"]["states"] if "bindings" in s)["bindings"][0].update(basis=["q"]),
    "source twice": lambda d: d["sourceSchemas"].append(d["sourceSchemas"][0]),
    "digest": lambda d: d["sourceSchemas"][0].update(digest="x"),
    "scope": lambda d: d.update(scope={"kind": "issuers", "issuerIds": ["a"]}),
    "extension point": lambda d: d["extensionPoints"].append({"prefix": [{"key": "none"}], "note": "x"}),
    "key not normal": lambda d: d["automaton"]["states"][0]["keys"][-1].update(key="z\u0301e\u0301"),
}


@pytest.mark.parametrize("name", CHANGES)
def test_load_is_strict(name):
    with pytest.raises(Rejected):
        _load(_changed(CHANGES[name]))


def test_load_by_content():
    data = A.write(_doc())
    with pytest.raises(Rejected, match="type-map-id-mismatch"):
        A.load(data + b" ", A.content_id(data))
    blob = _changed(lambda d: next(s for s in d["automaton"]["states"] if "bindings" in s)["bindings"][0].update(tag=8))
    with pytest.raises(Rejected, match="blob-ref-not-selectable"):
        _load(blob)


def _family(selector=("list", None, "c"), tag=2, kind="string", change=None):
    """A parent that may be extended in its list's objects and where open is unresolved, and a child of it."""
    points = [{"prefix": [{"key": "list"}, {"anyIndex": True}], "note": "more"}, {"prefix": [], "note": "gaps"}]
    parent = _load(_doc(extension_points=points))
    automaton = copy.deepcopy(parent.doc["automaton"])
    segments = [{"anyIndex": True} if x is None else {"key": x} for x in selector]
    states = {s["id"]: s for s in automaton["states"]}
    # A way of its own to the selector, so that nothing else changes.
    fresh = iter(f"new{i}" for i in range(9))
    at = states["s0"]
    for k, x in enumerate(selector):
        nxt = at.get("anyIndex") if x is None else next((t["to"] for t in at.get("keys", []) if t["key"] == x), None)
        made = {**copy.deepcopy(states[nxt]), "id": next(fresh)} if nxt else {"id": next(fresh)}
        states[made["id"]] = made
        automaton["states"].append(made)
        if x is None:
            at["anyIndex"] = made["id"]
        else:
            at["keys"] = [t for t in at.get("keys", []) if t["key"] != x] + [{"key": x, "to": made["id"]}]
        at = made
    at.setdefault("bindings", []).append({"jsonKind": kind, "tag": tag, "basis": ["profile-ruling"], "sources": ["more"]})
    at.pop("unresolved", None)
    if change:
        change(states)
    more = {"sourceId": "more", "kind": "content", "uri": "https://a.b/more", "digest": "sha256:" + "1" * 64}
    added = [{"segments": segments, "jsonKind": kind, "tag": tag, "evidence": ["more"]}]
    child = A.artifact(automaton, "a.b", "1", "1.1.0", [*SOURCES, more], parent.doc["coverage"]["structurallyUntypedObjectSourceNodes"], points, parent.id, ["urn:i"], added)
    return parent, _load(child, issuer_children=True)


def test_extension():
    assert A.check_extension(*_family()) == []
    assert A.check_extension(*_family(("open",), 4, "number")) == []
    assert any("extension point" in w for w in A.check_extension(*_family(("loose", "y"))))
    assert any("extension point" in w for w in A.check_extension(*_family(("n",), 2)))
    ruled = lambda states: states[next(t["to"] for t in states["s0"]["keys"] if t["key"] == "n")]["bindings"][0].update(basis=["profile-ruling"])
    assert any("changed" in w for w in A.check_extension(*_family(change=ruled)))
    assert any("no added selector" in w for w in A.check_extension(*_family(change=lambda s: s["new2"].setdefault("bindings", []).append({"jsonKind": "boolean", "tag": 1, "basis": ["profile-ruling"], "sources": ["more"]}))))
    parent, child = _family()
    with pytest.raises(Rejected):
        _load(child.doc)
    assert A.check_extension(_load(_doc()), child)


def test_registry():
    data = A.write(_doc())
    entry = {"id": A.content_id(data), "path": "m.json", "typeMapVersion": "1.0.0", "recordType": "a.b", "schemaVersion": "1", "scope": {"kind": "profile"}}
    registry = {"format": A.REGISTRY, "registryVersion": "1.0.0", "idAlgorithm": {"name": "sha256"}, "maps": [entry]}
    assert A.check_registry(registry, {"m.json": data}) == []
    assert A.check_registry(registry, {}) and A.check_registry(registry, {"m.json": data + b"\n"})
    assert A.check_registry(registry | {"maps": [entry, entry]}, {"m.json": data}) and A.check_registry(registry | {"maps": [entry | {"schemaVersion": "2"}]}, {"m.json": data})


def test_patterns_from_a_sample():
    automaton, _ = A.compile_schema(SCHEMA, "r.json")
    sample = [(["n"], "number"), (["open"], "number"), (["list", 0], "string"), (["list", 7], "string"), (["nowhere"], "string")]
    found, unbound = A.derive_patterns(automaton, sample)
    assert found.entries == [("n", "number", 3), ("list[*]", "string", 2)] and unbound == [("open", "number"), ("nowhere", "string")]
    ruled, left = A.derive_patterns(automaton, sample, {("open", "number"): 4})
    assert ("open", "number", 4) in ruled.entries and left == [("nowhere", "string")]
    with pytest.raises(Rejected, match="ruling-without-gap"):
        A.derive_patterns(automaton, sample, {("n", "number"): 4})

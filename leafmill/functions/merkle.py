"""Hash trees (RFC 9162) over arrays of leaf hashes, as column functions; and the one builder of leaf preimages.

Pairing neighbours level by level and moving an odd last node up unchanged gives exactly the tree of the RFC's
recursive split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.binary import u32be, u64be


def _b(x: bytes) -> Column:
    return F.lit(bytearray(x))


def sha256(b: Column) -> Column:
    return F.unhex(F.sha2(b, 256))


def domain(ordering: str = "path", algorithm: str = C.HASH_ALG) -> bytes:
    """The domain string of an algorithm and an ordering; others than those defined are refused."""
    if algorithm != C.HASH_ALG:
        raise ValueError("hash-alg-not-allowed")
    if ordering not in C.ORDERINGS:
        raise ValueError("ordering-not-defined")
    return f"{C.CANON}/{algorithm}{C.ORDERINGS[ordering]}".encode()


def leaf_hash(encoded_path: Column, tag: Column, value: Column, salt: Column, ordering: str = "path") -> Column:
    d = domain(ordering)
    one = F.unhex(F.lpad(F.hex(tag.cast("bigint")), 2, "0"))
    head = b"\x00" + len(d).to_bytes(4, "big") + d
    preimage = F.concat(_b(head), u32be(F.octet_length(encoded_path)), encoded_path, one, _b(C.SALT_BYTES.to_bytes(4, "big")), salt, u64be(F.octet_length(value)), value)
    return F.when(F.octet_length(salt) == C.SALT_BYTES, sha256(preimage))


def node_hash(left: Column, right: Column) -> Column:
    return sha256(F.concat(_b(b"\x01"), left, right))


def _shift(n: Column, by: Column) -> Column:
    return F.call_function("shiftright", n, by)


def split_point(n: Column) -> Column:
    """The largest power of two below n, for n of 2 or more."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n - 1)) - 1)


def _up(level: Column) -> Column:
    at = lambda i: F.get(level, i)
    half = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: F.when(2 * i + 1 < F.size(level), node_hash(at(2 * i), at(2 * i + 1))).otherwise(at(2 * i)))


def _steps(leaves: Column) -> Column:
    """One element for each level above the leaves."""
    return F.when(F.size(leaves) > 1, F.sequence(F.lit(1), F.length(F.bin((F.size(leaves) - 1).cast("bigint"))))).otherwise(F.array().cast("array<int>"))


def root(leaves: Column) -> Column:
    """The root over leaf hashes in tree order; of none, the hash of nothing."""
    return F.when(F.size(leaves) > 0, F.get(F.aggregate(_steps(leaves), leaves, lambda level, _: _up(level)), F.lit(0))).otherwise(sha256(_b(b"")))


def levels(leaves: Column) -> Column:
    """All levels, from the leaves to the root."""
    return F.aggregate(_steps(leaves), F.array(leaves), lambda all_, _: F.concat(all_, F.array(_up(F.element_at(all_, -1)))))


def audit_path(levels_: Column, index: Column) -> Column:
    """The siblings from a leaf to the root; a level where the node moves up unchanged gives none."""
    below = F.slice(levels_, 1, F.size(levels_) - 1)
    siblings = F.transform(below, lambda level, l: F.get(level, _shift(index.cast("bigint"), l).cast("int").bitwiseXOR(F.lit(1))))
    return F.array_compact(siblings)


def verify_inclusion(leaf: Column, index: Column, size: Column, path: Column, root_: Column) -> Column:
    """Whether path leads from leaf at index to root_ in a tree of size leaves. Paths too long or too short fail."""
    start = F.struct(index.cast("bigint").alias("f"), (size.cast("bigint") - 1).alias("s"), leaf.alias("r"), F.lit(True).alias("ok"))

    def step(a: Column, p: Column) -> Column:
        f, s, r = a["f"], a["s"], a["r"]
        right = (f % 2 == 1) | (f == s)
        # Where the node was the last of an even level it has moved up: skip its trailing zeros.
        skip = F.when((f == s) & (f % 2 == 0) & (f > 0), F.bit_count(f.bitwiseAND(-f) - 1)).otherwise(F.lit(0)) + 1
        down = lambda n: _shift(n, skip)
        return F.struct(down(f).alias("f"), down(s).alias("s"), F.when(right, node_hash(p, r)).otherwise(node_hash(r, p)).alias("r"), (a["ok"] & (s > 0)).alias("ok"))

    good = F.aggregate(path, start, step, lambda a: a["ok"] & (a["s"] == 0) & (a["r"] == root_))
    return F.coalesce((index >= 0) & (index < size) & good, F.lit(False))

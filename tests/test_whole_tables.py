"""Queries whose SQL looks at some rows only, over whole tables, against brute force."""

import hashlib
import re
from collections import Counter
from decimal import Context, Decimal

import pytest

from leafmill.plans import queries as plans

WIDE = Context(prec=5000, Emax=999_999, Emin=-999_999)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Keys of every remainder, so that a filter by key shows."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 7 * k % 90) for k in range(120)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k, n, float(1 + (3 * k + n) % 50)) for k in range(60) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


def _rows(df):
    return Counter(map(tuple, df.collect()))


def _integer(s):
    if not re.fullmatch("-?(0|[1-9][0-9]*)", s):
        return None, "integer-grammar"
    return (None, "digit-bound-exceeded") if len(s.lstrip("-")) > 1024 else (str(int(s)), None)


def _decimal(s):
    m = re.fullmatch(r"-?(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?", s)
    if not m:
        return None, "decimal-grammar"
    whole, fraction, e = m[1], m[2] or "", int(m[3] or 0)
    point, n = len(whole) + e, len(whole + fraction)
    if max(n, point, n - point) > 1024:
        return None, "digit-bound-exceeded"
    # A positive exponent beyond the fraction leaves no point; Decimal's own places do the rest.
    out = format(WIDE.create_decimal(s), "f")
    return (out if Decimal(s) else out.lstrip("-")), None


def test_canonical_integer(spark, tables):
    want = Counter()
    for key in range(120):
        k = str(7 * key % 90)
        for s in (k, "-" + k, "-0", "0" + k, k + ".0", "+" + k, "9" * 1024, "9" * 1025):
            want[key, hashlib.sha256(s.encode()).hexdigest(), *_integer(s)] += 1
    assert _rows(plans.canonical_integer(spark, tables).select("o_orderkey", "s", "canonical", "reason")) == want


def test_canonical_decimal(spark, tables):
    want = Counter()
    for key in range(60):
        for n in (1, 2):
            q = str(1 + (3 * key + n) % 50)
            for s in (q + ".50", q + "e2", f"-{q}.0e-3", "-0.00", q + ".250E+1", q + "e-5", q + ".", ".5", "0" + q, q + "e1024", "1e1023", q + "e99999999999", "0e5"):
                want[key, n, s, *_decimal(s)] += 1
    assert _rows(plans.canonical_decimal(spark, tables).select("l_orderkey", "l_linenumber", "s", "canonical", "reason")) == want


def test_json_literals(spark, tables):
    want = Counter()
    for k in range(120):
        for row in (("n", "number", f"{k}.010"), ("e", "number", "1e2"), ("big", "number", "9223372036854775808"), ("t", "boolean", "true"), ("o", "object", None), ("a[0]", "null", None)):
            want[k, *row] += 1
    assert _rows(plans.json_literals(spark, tables).select("o_orderkey", "display", "json_kind", "literal")) == want

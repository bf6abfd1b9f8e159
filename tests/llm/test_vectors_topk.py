"""Vector operators against plain loops over all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from reelspark.llm.components import components
from reelspark.llm.topk import exact_top_k
from reelspark.llm.vectors import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, block int, n_links string"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def vectors(seed=2, n=240, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, d))
    rows = []
    for k in range(n):
        v = base[rng.integers(20)] + rng.normal(size=d) * rng.choice([0.01, 0.12, 0.15, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3)) if k % 17 else None))
    one = rows[5][1]
    rows += [(1000 + k, [x * (k + 1) for x in one], rows[5][2]) for k in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [float("nan")] * d, 1), (2004, [None] + one[1:], 1), (2005, one[:5], 1),
             (2006, one[:5], 1), (None, one, 1), (2007, [float("inf")] + one[1:], 1), (2020, one[:3], 0)]
    return rows


def links(rows, t=0.98):
    ok = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and g is not None and usable(v) and any(v)]
    return {(a[0], b[0]) for a in ok for b in ok if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1])
            and a[1] @ b[1] / math.sqrt(a[1] @ a[1]) / math.sqrt(b[1] @ b[1]) >= t}


def test_links_and_components(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = links(rows)
    comp = {i: i for i, _, _ in rows}
    for _ in range(len(rows)):
        new = {i: min([c] + [comp[b] for a, b in want if a == i]) if i is not None else None for i, c in comp.items()}
        if new == comp:
            break
        comp = new
    expect = sorted(((i, sum(a == i for a, _ in want), comp[i], comp[i] == i) for i, _, _ in rows), key=str)
    assert len(want) > 500
    for tile in (2048, 7):   # small tiles split every large cell
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, tile=tile).collect()), key=str)
        assert got == expect
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_top_k(spark):
    rows = vectors(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    want = set()
    for q, qv in ints:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ints if i != q and len(v) == len(qv))
            want |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:20])}
    for block in (4096, 3):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(df, F.col("vec_id") % 20 == 0, query_block=block).collect()}
        assert got == want
    assert exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_top_k(df, F.lit(False)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 200: 100, 301: 300, 302: 300}

"""Near-duplicates against exact similarities of all pairs."""

import collections
import itertools

import numpy as np
import pytest

from reelspark.llm.components import components
from reelspark.llm.minhash import drop_near_duplicates, near_duplicates, probability_jaccard, shingles, signatures, REGISTERS
from reelspark.llm.textops import U64, mix

from ..conftest import SF01


def bag(text):
    w = [x.decode().translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").encode().split()]
    if 0 < len(w) < 5:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def p_jaccard(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys())


def brute_classes(rows, threshold=0.8):
    bags = {i: bag(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, b in bags.items():
        for s in b:
            holders[s].append(i)
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, y in {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}:
        if p_jaccard(bags[x], bags[y]) >= threshold:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {i: find(i) for i in bags}


def test_probability_jaccard_and_registers():
    rng = np.random.default_rng(1)
    a = {int(k): int(w) for k, w in zip(range(60), rng.integers(1, 4, 60))}
    b = {int(k): int(w) for k, w in zip(range(15, 80), rng.integers(1, 4, 65))}
    want = p_jaccard(collections.Counter(a), collections.Counter(b))
    arr = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    assert probability_jaccard(*arr) == pytest.approx(want)
    agree = 0
    for seed in range(40):
        key = lambda v: mix(np.asarray(v, U64) + U64(seed * 1000 + 7))
        doc = np.array([0] * len(a) + [1] * len(b))
        sig = signatures(doc, np.concatenate([key(arr[0][0]), key(arr[1][0])]), np.concatenate([arr[0][1], arr[1][1]]), 2)
        agree += (sig[0] == sig[1]).sum()
    assert agree / (40 * REGISTERS) == pytest.approx(want, abs=0.03)


def test_shingles_of_short_texts():
    h = np.arange(1, 12, dtype=U64)
    doc = np.array([0, 0, 2, 2, 2, 2, 2, 2, 3, 3, 3])
    d, s, w = shingles(h, doc, 4)
    assert d.tolist() == [0, 2, 2, 3] and len(set(s.tolist())) == 4 and w.tolist() == [1] * 4


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (3, long.replace("w59", "zz")), (9, long.upper()), (7, None), (8, None), (1, ""), (2, " \n "), (4, "one two"),
            (6, "one  two"), (10, "two one"), (None, long), (11, "other " * 40), (11, "other " * 40)]
    got = near_duplicates(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, rep string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.class_id, r.kept, r.copy_of) for r in got}
    assert by[5] == (3, False, 5) and by[9] == (3, False, 5) and by[3] == (3, True, 3)
    assert by[6] == (4, False, 4) and by[10] == (10, True, 10)
    assert all(by[i] == (i, True, i) for i in (7, 8, 1, 2, 11)) and by[None] == (None, True, None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == want
    assert sum(i != c for i, c in got.items()) > 20


def test_several_texts_of_one_id(spark):
    """No link is lost where an id has another text beside; classes are named by the least id."""
    a = " ".join(f"w{k}" for k in range(60))
    near = " ".join(f"w{k}" for k in range(59)) + " x"
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, a), (2, near), (2, other), (2, other), (3, other + " end"), (4, "alone here"), (None, a), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.kept, str(r.copy_of)) for r in near_duplicates(df).collect())
    assert len(got) == len(rows)
    assert sorted(x[:2] for x in got) == sorted([("1", "1"), ("2", "1"), ("2", "2"), ("2", "2"), ("3", "2"), ("4", "4"), ("None", "None"), ("5", "5"), ("5", "5")])
    assert sum(k for i, c, k, _ in got if c == "1") == 1 and sum(k for i, c, k, _ in got if c == "2") in (1, 2)
    left = sorted((str(r.doc_id), str(r.text)) for r in drop_near_duplicates(df).collect())
    assert ("1", a) in left and ("3", other + " end") not in left and left.count(("2", other)) == 1 and ("None", a) in left


def test_a_very_long_text(spark):
    """A text of 50,000 words, a near copy of it and one of its halves."""
    words = [f"w{(k * 7919) % 150_001}" for k in range(50_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-100])), (3, " ".join(words[:25_000])), (4, "short text of a few words")]
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}


def test_links_between_groups_join_least_ids(spark, monkeypatch):
    """A chain of near copies: only the groups' least ids go through the second search for components, and none is lost."""
    from reelspark.llm import minhash
    seen = []

    def counted(edges, a, b, name):
        seen.append((a, b, {x for r in edges.select(a, b).collect() for x in r}))
        return components(edges, a, b, name)
    monkeypatch.setattr(minhash, "components", counted)
    words = [f"w{k}" for k in range(400)]
    rows = [(90 - k, " ".join(words[8 * k:8 * k + 200])) for k in range(12)] + [(200 + k, " ".join(words[8 * k:8 * k + 200]) + " end") for k in range(12)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert [x[:2] for x in seen] == [("a", "b"), ("grp_a", "grp_b")]


def test_few_edges_need_no_shuffle(spark, monkeypatch):
    from reelspark.llm import components as module
    plans, rng = [], np.random.default_rng(2)
    real = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    df = spark.createDataFrame(edges, "a long, b long")
    few = {(r.node, r.component) for r in components(df, "a", "b").collect()}
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    monkeypatch.setattr(module, "FEW_EDGES", 10)
    assert few == {(r.node, r.component) for r in components(df, "a", "b").collect()}
    assert "Exchange hashpartitioning" in plans[-1]

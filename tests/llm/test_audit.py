"""The filter audit against applying every order to every document one by one."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from reelspark.llm import audit

LONG = " ".join(f"w{k}" for k in range(120))
ROWS = [  # id, text, lang
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (3, LONG, None), (4, None, "de"), (5, "", "de"), (5, "", "de"), (6, " \n\t", ""),
    (7, "ABC DEF", "en"), (8, "a a a a b", "fr"), (9, "one # two", "fr"), (10, "word " * 200_000, "en"), (None, LONG, "en"), (None, None, "xx"),
    (11, LONG + "\x0bw1\x0cw2\rw3", "en"), (12, LONG.upper(), "en"), (13, "é" * 9 + "A", "fr"), (14, "é" * 8 + "A", "fr"), (15, LONG + " $", None),
    (16, LONG + " | " + LONG, "en"), (0, LONG, "zz")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (8, 1, 0), (99, 1, 1), (None, 1, 1), (16, 1, 1)]


def fails(rows, k):
    i, text, _ = rows[k]
    t = text or ""
    ws = re.findall("[^\x20\x09-\x0D]+", t)
    out = set()
    if len(ws) < 100:
        out.add("A")
    if 100 * len(set(ws)) < 80 * len(ws):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
        out.add("C")
    if re.search("[#$%&*|]", t):
        out.add("D")
    if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    found = [(lang or "", fails(rows, k), any(a == i and q == 1 for a, q, _ in labels if a is not None),
              any(a == i and t == 1 for a, _, t in labels if a is not None)) for k, (i, _, lang) in enumerate(rows)]
    out, removed = {}, defaultdict(int)
    for part in {f[0] for f in found}:
        for order in permutations("ABCDE"):
            left = [f for f in found if f[0] == part]
            every = list(left)
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                before = len(left)
                left = [f for f in left if x not in f[1]]
                out[part, "".join(order), step] = [len(left), before - len(left), sum(x in f[1] for f in every) - len(gone),
                                                   sum(f[1] == {x} for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed[part, x] += len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, 1, "m") for i, t, g in rows], "doc_id long, text string, lang string, n int, mask string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.filter_audit(*frames(spark, ROWS, LABELS)).collect()}
    assert got == brute(ROWS, LABELS)


def test_fields_do_not_run_over(spark):
    big = [("p", 31, True, True, 2**62), ("p", 31, True, True, 2**62 - 1), ("p", 0, False, False, 5), ("q", 16, False, True, 3)]
    counts = spark.createDataFrame(big, "part string, mask int, good boolean, toxic boolean, n long")
    rows = {(r.part, r.filter_order, r.step): r for r in audit.interaction_report(counts, "ABCDE").collect()}
    first, second = rows["p", "ABCDE", 1], rows["p", "ABCDE", 2]
    assert (first.kept, first.removed, first.redundant, first.good_lost) == (5, 2**63 - 1, 0, 2**63 - 1)
    assert (second.kept, second.removed, second.redundant, second.unique_fails) == (5, 0, 2**63 - 1, 0)
    assert [rows["q", "ABCDE", 5][c] for c in ("removed", "unique_fails", "toxic_lost", "shapley")] == [3, 3, 3, 360]


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 3, False, False, 7)], "part string, mask int, good boolean, toxic boolean, n long")
    got = sorted((r.filter_order, r.step, r.removed, r.redundant) for r in audit.interaction_report(counts, "xy").collect())
    assert got == [("xy", 1, 7, 0), ("xy", 2, 0, 7), ("yx", 1, 7, 0), ("yx", 2, 0, 7)]


@pytest.mark.parametrize("docs, labels", [(0, 1), (1, 0)])
def test_empty_tables(spark, docs, labels):
    d, lab = frames(spark, ROWS * docs, LABELS * labels)
    got = audit.filter_audit(d, lab)
    assert got.count() == 600 * len({g or "" for _, _, g in ROWS * docs})
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

"""The language model against a plain forward recursion and plain counts."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm.lm import CLASSES, STATES, Hmm, held_out, sample_fit, score_documents

from ..conftest import SF01


def random_model(rng):
    return Hmm(rng.dirichlet(np.ones(STATES)), rng.dirichlet(np.ones(STATES), STATES), rng.dirichlet(np.ones(CLASSES), STATES).T)


def plain_forward(m, seq):
    a, total = m.start * m.emit[seq[0]], 0.0
    for k, c in enumerate(seq):
        if k:
            a = (a @ m.move) * m.emit[c]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    m = random_model(rng)
    sizes = np.array([1, 3, 250, 11, 10, 1, 9, 21])
    seq = rng.integers(0, CLASSES, sizes.sum())
    want = [plain_forward(m, s) for s in np.split(seq, np.cumsum(sizes)[:-1])]
    assert m.log10_likelihood(seq, sizes) == pytest.approx(want)
    assert len(m.log10_likelihood(seq[:0], sizes[:0])) == 0


def test_baum_welch_counts_and_growing_likelihood():
    rng = np.random.default_rng(1)
    m = random_model(rng)
    sizes = np.array([5, 1, 300, 40])
    seq = rng.integers(0, 50, sizes.sum())
    starts, moves, emits = m.expected_counts(seq, sizes)
    pieces = int((-(-sizes // 128)).sum())
    assert starts.sum() == pytest.approx(pieces)
    assert moves.sum() == pytest.approx(sizes.sum() - pieces)
    assert emits.sum(axis=1)[:50] == pytest.approx(np.bincount(seq, minlength=50))
    base = np.full(CLASSES, 1e-9)
    before = m.log10_likelihood(seq, sizes).sum()
    for _ in range(3):
        m = Hmm.from_counts(*m.expected_counts(seq, sizes), base)
        after = m.log10_likelihood(seq, sizes).sum()
        assert after >= before - 0.5
        before = after
    assert sample_fit(seq[:0], sizes[:0], np.full(CLASSES, 1 / CLASSES)).emit.shape == (CLASSES, STATES)


def brute_base(rows, train):
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = collections.Counter(w for i, ws in split if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
                   for i, ws in split), key=str)


def digest(rows):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


def is_train(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0


def test_edge_rows(spark):
    rows = [(1, "The the cat"), (2, None), (3, ""), (4, "a\x0bB \t a"), (4, "a b a"), (4, "a b a"), (None, "cat dog"), (7, "É é unseen " * 40), (11, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n long, h string")
    got = score_documents(df, ~held_out()).collect()
    assert digest(got) == brute_base(rows, is_train)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert digest(score_documents(df, held_out() & ~held_out()).collect()) == brute_base(rows, lambda i: False)
    assert score_documents(df.limit(0), ~held_out()).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = score_documents(docs, ~held_out()).collect()
    assert digest(got) == brute_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], is_train)
    out = [r for r in got if not is_train(r.doc_id)]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert gain > 0.1      # the model is better than the unigram on documents it has not seen


def test_the_word_table_keeps_its_bound(spark):
    """Words of equal counts share a fate, however common: none of more than the bound comes to the driver."""
    from reelspark.llm.lm import word_table
    rows = [(k, 20_100 + k % 7, 5_000_000) for k in range(300)] + [(k, 20_100, 9_000_000 + 100_000 * k) for k in range(1000, 1020)] + [(k, 20_100, 3) for k in range(2000, 2100)]
    counts = spark.createDataFrame(rows, "h long, ending int, n long")
    for bound, held in ((100, 20), (319, 20), (320, 320), (419, 320), (420, 420), (7, 7), (0, 0)):
        table, _, _ = word_table(counts, 5, bound)
        assert len(table.hash) == held
        assert table.n_tokens == sum(n for _, _, n in rows) + 5 and table.n_distinct == len(rows) + 1


def test_the_start_counts_every_neighbour():
    from reelspark.llm.lm import END, NEIGHBOUR_WORDS, NEIGHBOURS, neighbour_cells, start_fit
    rng = np.random.default_rng(4)
    docs = [[*rng.integers(0, CLASSES - 1, n).tolist(), END] for n in (0, 1, 3, 3000)]
    seq, sizes = np.array([c for d in docs for c in d]), np.array([len(d) for d in docs])

    def group(c):
        return c if c < NEIGHBOUR_WORDS else NEIGHBOURS - 1 if c == END else NEIGHBOUR_WORDS + c % (NEIGHBOURS - 1 - NEIGHBOUR_WORDS)
    want = collections.Counter()
    for d in docs:
        for a, b in zip(d, d[1:]):
            want[b * 2 * NEIGHBOURS + group(a)] += 1
            want[a * 2 * NEIGHBOURS + NEIGHBOURS + group(b)] += 1
    assert collections.Counter(neighbour_cells(seq, sizes).tolist()) == want
    none = start_fit(np.zeros(0, int), np.zeros(0, int), np.full(CLASSES, 1 / CLASSES))
    assert none.emit.sum(axis=0) == pytest.approx(np.ones(STATES))


def test_the_model_learns_from_every_training_text(spark):
    """No text stands for others: which ids the texts bear says nothing, and a document's late words shape the model as its first do."""
    rng = np.random.default_rng(6)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "abcd"]
    texts = [" ".join(rng.choice(kinds[k % 4], 8)) for k in range(3000)]

    def scores(shift):
        df = spark.createDataFrame([(k + shift, k, t) for k, t in enumerate(texts)], "doc_id long, k long, text string")
        found = score_documents(df, F.col("k") % 10 != 0).join(df.select("doc_id", "k"), "doc_id").collect()
        return [r.score for r in sorted(found, key=lambda r: r.k)]
    assert scores(0) == pytest.approx(scores(1_000_000), rel=1e-6)

"""Classifiers and the pipeline's stages against plain versions, row by row."""

import math
import random

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline as P
from reelspark.llm import langid
from reelspark.llm.mixing import oracle as mixing_oracle
from reelspark.llm.queries import tokenizer_path
from reelspark.llm.toxicity import FactorizationMachine, sigmoid

from .test_lines import brute_repeated
from .test_minhash import brute_classes
from .test_packing import expect


def plain_score(m, slots):
    """The sum over terms and over pairs of terms, written out."""
    at = [int(np.searchsorted(m.slots, s)) for s in slots]
    return m.w0 + sum(m.w[i] for i in at) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(at) for b in at[k + 1:])


def machine(seed=1, n=12):
    m, rng = FactorizationMachine(np.arange(0, 5 * n, 5), 0.3), np.random.default_rng(seed)
    m.w[:], m.v[:] = rng.normal(0, 1, m.w.shape), rng.normal(0, 1, m.v.shape)
    return m


def test_machine_scores_are_sums_over_pairs():
    m, rng = machine(), random.Random(2)
    docs = [sorted(rng.sample(m.slots.tolist(), rng.randint(0, 8))) for _ in range(20)]
    doc = np.repeat(np.arange(20), [len(d) for d in docs])
    idx = np.searchsorted(m.slots, [s for d in docs for s in d]).astype(np.int64)
    assert m.raw(doc, idx, 20) == pytest.approx([plain_score(m, d) for d in docs])


def test_first_step_of_the_fit_follows_the_numeric_gradient():
    m, rng = machine(3, 6), random.Random(5)
    rows = [np.array(sorted(rng.sample(range(6), rng.randint(1, 4)))) for _ in range(40)]
    y = np.array([rng.randint(0, 1) for _ in rows], float)

    def loss(m):
        raw = np.array([plain_score(m, [m.slots[i] for i in r]) for r in rows])
        p = sigmoid(raw)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * ((m.w ** 2).sum() + (m.v ** 2).sum()))
    before, grads = (m.w.copy(), m.v.copy()), (np.zeros_like(m.w), np.zeros_like(m.v))
    for x, g in zip((m.w, m.v), grads):
        for at in np.ndindex(x.shape):
            x[at] += 1e-6
            up = loss(m)
            x[at] -= 2e-6
            g[at] = (up - loss(m)) / 2e-6
            x[at] += 1e-6
    m.fit(rows, y, epochs=1)
    for was, now, g in zip(before, (m.w, m.v), grads):       # one step goes by the sign of each gradient
        sure = np.abs(g) > 1e-5
        assert sure.mean() > 0.9 and (np.sign(was - now)[sure] == np.sign(g)[sure]).all()


def plain_bits(text, dictionary, params):
    """Bits of the frames of all chunks, each of which must come back."""
    total = 0
    for k in range(0, len(text), langid.CHUNK):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        frame = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(text[k:k + langid.CHUNK])
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(frame, max_output_size=langid.CHUNK) == text[k:k + langid.CHUNK]
        total += 8 * len(frame)
    return total


def test_code_lengths_and_margin_are_plain_counts():
    rng = random.Random(6)
    words = {"aa": ["river", "stone", "walking", "under", "lights"], "bb": ["fluss", "stein", "gehen", "unter", "lichter"]}
    text = lambda g, n: " ".join(rng.choice(words[g]) for _ in range(n))
    model = {g: (text(g, 800).encode(), 1.0 + (g == "bb")) for g in words}
    comps = langid.compressors(model)
    fine = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=3, target_length=32,
                                               strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False)
    for sample in (text("aa", 5), text("bb", 900), text("aa", 300) + text("bb", 280), "x"):
        raw = sample.encode()
        want = [bits + plain_bits(raw, d, fine) for d, bits in model.values()]
        assert langid.code_lengths(raw, comps, 3) == want
        pieces = [raw[k:k + langid.PIECE] for k in range(0, len(raw), langid.PIECE)]
        each = [[8 * len(c[3].compress(p)) for p in pieces] for c in comps]
        total = [c[1] + sum(b) for c, b in zip(comps, each)]
        for winner in (0, 1):
            against = sum(each[winner][k] - min(each[0][k], each[1][k]) for k in range(len(pieces)))
            assert langid.margin(raw, comps, winner) == pytest.approx((total[1 - winner] - total[winner] - against) / total[winner])
    lang, score, lead, _ = langid.identify(text("bb", 60), comps)
    assert lang == "bb" and 0.5 < score <= 1 and lead > 0
    assert langid.identify("12 34 !", comps)[0] == langid.UNDETERMINED


# the pipeline's stages ------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small documents table with copies, near copies, repeated lines and rows, nulls, an empty and a long text, and junk."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(240).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real if r.text and len(r.text) < 1500][:110]
    a, b = rows[3], rows[7]
    near = " ".join(b[1].split()[:-1] + ["changed"])
    long = "\n".join(f"{r[1].split(chr(10))[0]} number {k}" for k, r in enumerate(rows[:60] * 40))
    rows += [(9001, a[1], a[2], "copies", 1), (9002, near, b[2], "copies", 1), (9003, None, "en", "nulls", None), (9004, "", None, None, 0),
             (9005, "  \n ", "en", "nulls", 4), (9006, "12 ## 99", "en", "junk", 8), (9007, long, rows[0][2], "long", len(long)), (9008, a[1] + "\n" + b[1], None, "mixed", 3),
             (9009, rows[9][1], rows[9][2], rows[9][3], 5), (9009, rows[9][1], rows[9][2], rows[9][3], 5)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    return d


def stage(k):
    return P.STAGES[k][1]


def keyed(rows):
    return sorted((str(r.doc_id), str(r.text)) for r in rows)


@pytest.fixture(scope="module")
def steps(spark, corpus):
    """What goes into every stage and what comes out, written and read again as the next one's input."""
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for k in range(5):
        path = f"{corpus}/step{k}"
        stage(k)(spark, docs, corpus).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_language_stage(spark, steps):
    docs, got = steps[0]
    model, least = langid.train(docs, langid.training_rows())
    comps, want = langid.compressors(model), []
    for r in docs.collect():
        raw = (r.text or "").lower().encode()
        lang, _, lead, m = langid.identify(r.text or "", comps)
        if lang != "und" and lead >= langid.MIN_MARGIN_BITS and m >= least[lang]:
            bits = [c[1] + sum(8 * len(c[i].compress(raw[k:k + langid.CHUNK])) for k in range(0, len(raw), langid.CHUNK)) for c in comps for i in (3,)]
            want.append((str(r.doc_id), str(r.text), lang))
            assert lang == comps[bits.index(min(bits))][0] or sorted(bits)[1] - min(bits) < langid.RECHECK * min(bits)
    assert sorted((str(r.doc_id), str(r.text), r.lang) for r in got.collect()) == sorted(want)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in got.collect()}
    assert {9003, 9004, 9005, 9006} <= gone and len(gone) < 20 and 9007 not in gone


def test_line_stage(spark, steps):
    docs, got = steps[1]
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()})
    kept = {i: keep for (i, *_), keep in zip(sorted((str(i),) for i, _ in rows), [x[3] for x in brute_repeated(spark, rows)])}
    want = []
    for i, text in rows:
        rest = "\n".join(text.split("\n")[k] for k in kept[str(i)])
        if rest == text or rest.split():
            want.append((str(i), rest))
    assert keyed(got.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_duplicate_stage(steps):
    docs, got = steps[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = brute_classes(rows)
    assert keyed(got.collect()) == sorted((str(i), str(t)) for i, t in rows if classes[i] == i)


def test_mixing_stage(steps, corpus):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{corpus}/step2/*.parquet')")
    want = con.execute(mixing_oracle() + " SELECT doc_id, text FROM copies").fetchall()
    assert keyed(steps[3][1].collect()) == sorted((str(i), str(t)) for i, t in want)


def check_packed(docs, packed):
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(r.doc_id), *p) for r in docs for p in expect(tok, r.text))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    room = {}
    for r in packed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in room.values():
        ends = [0, *(o + n for o, n in sorted(seq))]
        assert [o for o, _ in sorted(seq)] == ends[:-1] and ends[-1] <= 4096
    assert len(room) <= math.ceil(sum(r.length for r in packed) / 4096) + 1


def test_packing_stage_and_the_whole_run(spark, steps, corpus):
    docs, got = steps[4]
    check_packed(docs.collect(), got.collect())
    check_packed(docs.collect(), P.run(spark, corpus).collect())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "only one text here", "en", "s", 18)]])
def test_stages_on_tiny_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for k in range(5):
        out = stage(k)(spark, docs, "")
        assert out.columns == (docs.columns if k < 4 else ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        out.count()

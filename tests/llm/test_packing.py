"""Packing against the tokenizer itself and against the plain lower bound on sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelspark.llm.packing import fill_bins, pack_best_fit

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(1, "The quick brown fox, isn't it?"), (2, None), (3, ""), (4, "x" * 9000), (5, "word " * 5000),
         (6, "naïve café au lait é <|endoftext|>\x1cA B ÀÉ"), (6, "again"), (None, "null id"),
         (7, "The quick brown fox, isn't it?"), (8, " \n\t "), (9, "ΣΑΣ σας İ I'LL we've 12345 --- ...")]


def expect(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k, k * 4096, len(ids[k * 4096:(k + 1) * 4096]),
             zlib.crc32(np.asarray(ids[k * 4096:(k + 1) * 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in TEXTS], "doc_id long, text string, part string, piece int")
    return pack_best_fit(docs, PATH).collect()


def test_ids_are_the_tokenizers(packed):
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), *p) for i, t in TEXTS for p in expect(tok, t))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_sequences_are_gapless(packed):
    seqs = {}
    for r in packed:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in seqs.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) == -(-sum(r.length for r in packed) // 4096)


def test_empty_table(spark):
    assert pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_fill_bins_beats_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 4097, 1500), np.full(100, 1366), np.array([4096, 1, 4095, 2]),
                    rng.integers(2049, 4097, 50), rng.integers(1, 600, 2000), np.zeros(0, int)):
        bins, offs = fill_bins(lengths.astype(np.int64), 4096)
        load = np.bincount(bins, lengths) if len(lengths) else np.zeros(1)
        assert load.max() <= 4096
        assert len(set(bins.tolist())) <= best_fit_decreasing(lengths.tolist(), 4096)

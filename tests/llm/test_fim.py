"""Fill-in-middle against a plain version that works on one text at a time, and the exact round trip."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import fim

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
NAMES = ["plain", "psm", "spm"]


def numbers(doc_id):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def plain(text, h):
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def batch(texts, hashes):
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n, form, p, m, out, new = fim.transform(buf, off, np.array(hashes, np.int64).reshape(-1, 4))
    back, back_off = fim.restore(out, new, form)
    cut = lambda b, o: [b[x:y].tobytes().decode() for x, y in zip(o, o[1:])]
    rows = [(int(a), NAMES[f], int(x) if f else None, int(y) if f else None, t)
            for a, f, x, y, t in zip(n, form, p, m, cut(out, new))]
    return rows, cut(back, back_off)


PARTS = st.lists(st.sampled_from(["a", "é", "日本", " ", "  ", "\n", "\x0b", " ", "<", "<P>", "<S", ">", "S>", "<M>", " ", "𝄞"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), max_size=8), st.sampled_from([3, 7, 1 << 20]))
def test_kernel_equals_the_plain_version(rows, block):
    was, fim.BLOCK = fim.BLOCK, block
    try:
        texts, hashes = ["".join(t) for t, _ in rows], [h for _, h in rows]
        got, back = batch(texts, hashes)
    finally:
        fim.BLOCK = was
    assert got == [plain(t, h) for t, h in zip(texts, hashes)]
    assert back == texts


ROWS = [(1, "The quick  brown\tfox"), (2, None), (3, ""), (4, " \n "), (5, "naïve café <P> au lait"), (6, "word " * 300_000),
        (7, "x" * 3_000_000), (8, "日本 語 text here "), (8, "日本 語 text here "), (8, "another text of 8"), (None, "null id text here"),
        *[(k, f"{k} lorem ipsum dolor\n sit < amet> <S k{k}") for k in range(10, 60)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, row string, fim_text int").repartition(3)


def test_edge_rows(docs):
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "row", *fim.NEW]
    got = sorted((str(r.doc_id), r.text or "", r.fim_units, r.fim_form, str(r.fim_prefix_chars), str(r.fim_middle_chars), r.fim_text, r.restored)
                 for r in fim.restore_text(made).collect())
    want = []
    for i, t in ROWS:
        n, form, p, m, out = plain(t or "", numbers(i))
        want.append((str(i), t or "", n, form, str(p), str(m), out, t or ""))
    assert got == sorted(want)


def test_parameters(docs):
    all_psm = fim.fill_in_middle(docs, rate=100, spm_rate=0).where("fim_form <> 'plain'")
    assert {r[0] for r in all_psm.select("fim_form").distinct().collect()} == {"psm"}
    assert fim.fill_in_middle(docs, rate=0).where("fim_form <> 'plain'").count() == 0


def test_damaged_output_is_an_error():
    with pytest.raises(ValueError):
        fim.restore(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([fim.PSM]))


def test_empty_table(spark):
    out = fim.digests(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

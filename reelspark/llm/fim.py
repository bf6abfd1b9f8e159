"""Fill-in-middle transformation by displacement scatter.

A text is cut into units (white space and the word after it) and, at two hashed cuts, into prefix,
middle and suffix, which are put in another order with a sentinel before each.  A kernel works on the
bytes of many documents at once: a vectorised scan finds the unit ends, a difference array holds at the
first byte of every segment how far the output's place lies from the input's, its cumulative sum gives
each byte its shift, and one scatter builds all outputs.  The inverse finds the sentinels in the output,
makes the same kind of difference array, and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim, with_fields
from .textops import SPACE, text_buffer

#: Sentinels of the three parts, in the order prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Of 100 documents, so many are transformed; of 100 transformed ones, so many put the suffix first.
RATE, SPM_RATE = 50, 80
SEED = 42
#: Bytes of documents that are scattered together, and bytes of a block of shifts within them.
CHUNK, BLOCK = 1 << 22, 1 << 20
FORMS = np.array(["plain", "psm", "spm"], object)
PLAIN, PSM, SPM = 0, 1, 2


def runs(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes (a longer document is a run of its own)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def unit_ends(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending end positions of all units: the ends of words, and of documents that end in white space."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    word = ~SPACE[buf]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = off[1:][off[1:] > off[:-1]]
    last[ends - 1] = True
    return np.flatnonzero(last) + 1


def marked(buf: np.ndarray, middle: str = "PSM") -> np.ndarray:
    """Positions where a sentinel begins, whatever document its bytes lie in."""
    if len(buf) < MARK:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(buf[:-2] == ord("<"))
    return at[(buf[at + 2] == ord(">")) & np.isin(buf[at + 1], np.frombuffer(middle.encode(), np.uint8))]


def displaced(start: np.ndarray, place: np.ndarray, total: int, move) -> None:
    """Call ``move(lo, hi, to)`` block by block, ``to`` being where each byte of [lo, hi) belongs or comes from.

    Segments start at ``start`` (ascending) and lie at ``place``.  The difference array holds at each start by how
    much the displacement changes; its running sum is every byte's displacement.  Of segments that start at one
    byte only the last is not empty, so their changes may be added up.
    """
    step, carry = np.diff(place - start, prepend=0), 0
    for lo in range(0, total, BLOCK):
        hi = min(total, lo + BLOCK)
        a, b = np.searchsorted(start, (lo, hi))
        diff = np.zeros(hi - lo, np.int64)
        np.add.at(diff, start[a:b] - lo, step[a:b])
        to = np.cumsum(diff) + carry
        carry = int(to[-1])
        to += np.arange(lo, hi)
        move(lo, hi, to)


def code_points(buf: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Code points of ``buf`` before each of the ascending positions ``marks``."""
    out, seen, done = np.zeros(len(marks), np.int64), 0, 0
    for lo in range(0, len(buf) + 1, BLOCK):
        hi = min(len(buf), lo + BLOCK)
        b = int(np.searchsorted(marks, hi, "right" if hi == len(buf) else "left"))
        counts = np.concatenate(([0], np.cumsum((buf[lo:hi] & 0xC0) != 0x80)))
        out[done:b] = seen + counts[marks[done:b] - lo]
        seen, done = seen + int(counts[-1]), b
    return out


def transform(buf: np.ndarray, off: np.ndarray, hashes: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE):
    """(units, form, prefix code points, middle code points, output bytes, output offsets) of a run of documents.

    ``hashes`` has four columns, the numbers h1 to h4 of each document.
    """
    docs, size = len(off) - 1, np.diff(off)
    ends = unit_ends(buf, off)
    before = np.searchsorted(ends, off[:-1], "right")           # units that end before a document
    n = np.searchsorted(ends, off[1:], "right") - before
    taken = np.zeros(docs, bool)
    marks = marked(buf)
    if len(marks):
        doc = np.searchsorted(off, marks, "right") - 1
        taken[doc[marks + MARK <= off[doc + 1]]] = True
    form = np.where((n == 0) | taken | (hashes[:, 2] % 100 >= rate), PLAIN, np.where(hashes[:, 3] % 100 < spm_rate, SPM, PSM))
    c1, c2 = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)

    def cut(units: np.ndarray) -> np.ndarray:
        if not len(ends):
            return off[:-1]
        return np.where(units > 0, ends[np.maximum(before + units - 1, 0)], off[:-1])
    a, b = cut(np.minimum(c1, c2)), cut(np.maximum(c1, c2))
    p, m, s = a - off[:-1], b - a, off[1:] - b
    fim = form != PLAIN
    new_off = np.concatenate(([0], np.cumsum(size + 3 * MARK * fim)))
    base = new_off[:-1]
    place_p = base + np.where(form == SPM, 2 * MARK + s, np.where(fim, MARK, 0))
    place_m = base + np.where(fim, 3 * MARK + p + s, p)
    place_s = base + np.where(form == SPM, MARK, np.where(fim, 2 * MARK + p, p + m))
    start = np.stack((off[:-1], a, b), 1).ravel()
    place = np.stack((place_p, place_m, place_s), 1).ravel()
    out = np.empty(int(new_off[-1]), np.uint8)

    def scatter(lo: int, hi: int, to: np.ndarray) -> None:
        out[to] = buf[lo:hi]
    displaced(start, place, len(buf), scatter)
    for at, mark in ((place_p - MARK, PREFIX), (place_s - MARK, SUFFIX), (place_m - MARK, MIDDLE)):
        for k in range(MARK):
            out[at[fim] + k] = mark[k]
    chars = code_points(buf, start).reshape(-1, 3)
    return n, form, chars[:, 1] - chars[:, 0], chars[:, 2] - chars[:, 1], out, new_off


def restore(buf: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that :func:`transform` made ``buf`` from, told from the output and its form alone."""
    fim = form != PLAIN
    marks = marked(buf)
    doc = np.searchsorted(off, marks, "right") - 1 if len(marks) else marks
    marks = marks[fim[doc] & (marks + MARK <= off[doc + 1])] if len(marks) else marks
    if len(marks) != 3 * int(fim.sum()):
        raise ValueError("a transformed text has not exactly three sentinels")
    marks = marks.reshape(-1, 3)
    size = np.diff(off) - 3 * MARK * fim
    new_off = np.concatenate(([0], np.cumsum(size)))
    base, end = new_off[:-1], new_off[1:]
    # start of prefix, middle and suffix in the text, and where each lies in the output
    start, place = np.stack((base, end, end), 1), np.stack((off[:-1], off[1:], off[1:]), 1)
    spm = form[fim] == SPM
    sizes = np.stack((marks[:, 1] - marks[:, 0], marks[:, 2] - marks[:, 1]), 1) - MARK      # of the two parts that come first
    p = np.where(spm, sizes[:, 1], sizes[:, 0])
    m = off[1:][fim] - marks[:, 2] - MARK
    start[fim, 1], start[fim, 2] = base[fim] + p, base[fim] + p + m
    place[fim] = MARK + np.stack((np.where(spm, marks[:, 1], marks[:, 0]), marks[:, 2], np.where(spm, marks[:, 0], marks[:, 1])), 1)
    out = np.empty(int(new_off[-1]), np.uint8)

    def gather(lo: int, hi: int, to: np.ndarray) -> None:
        out[lo:hi] = buf[to]
    displaced(start.ravel(), place.ravel(), len(out), gather)
    return out, new_off


def text_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow string column over bytes that are valid UTF-8."""
    if int(off[-1]) < 2**31 - 1:
        return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


NEW = {"fim_units": "long", "fim_form": "string", "fim_prefix_chars": "long", "fim_middle_chars": "long", "fim_text": "string"}


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE,
                   spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """The input's columns and ``fim_units``, ``fim_form`` (plain, psm, spm), ``fim_prefix_chars``, ``fim_middle_chars``
    (code points, null if plain), ``fim_text``.

    Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.  The four numbers that place the cuts and choose the
    form are the first hexadecimal groups of sha256 of ``seed:id``, so the result does not depend on how rows are
    dealt to tasks.  A null text is empty; an empty text and one that holds a sentinel stay plain.  A null id counts as
    empty text in the hash.  Equal rows give equal results; columns of the input with a new column's name are replaced.
    A text of any length is handled whole: bytes are moved in blocks.  An empty table gives an empty one.
    No shuffle.
    """
    kept = [c for c in docs.columns if c not in NEW]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"fim_h{k}") for k in range(4)]
    rows = docs.select(F.struct(*kept).alias("row"), *groups, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("fim_in"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_buffer(batch.column(5))
            hashes = np.stack([batch.column(1 + k).to_numpy() for k in range(4)], 1)
            for lo, hi in runs(off):
                n, form, p, m, out, new = transform(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hashes[lo:hi], rate, spm_rate)
                plain = form == PLAIN
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()),
                     pa.array(p, pa.int64(), mask=plain), pa.array(m, pa.int64(), mask=plain), text_array(out, new)],
                    names=["row", *NEW])
        trim()

    out = rows.mapInArrow(kernel, with_fields(rows.select("row").schema, **NEW))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *NEW)


def restore_text(made: DataFrame, *, form_col: str = "fim_form", text_col: str = "fim_text", out_col: str = "restored") -> DataFrame:
    """The input's columns and ``out_col``: the text that ``text_col`` was made from, told from it and ``form_col`` alone.

    A null text or form is read as an empty plain text.  A text said to be transformed that has not exactly the three
    sentinels is an error.
    """
    kept = [c for c in made.columns if c != out_col]
    rows = made.select(F.struct(*kept).alias("row"), F.coalesce(F.col(form_col), F.lit("plain")).alias("form"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("made"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {name: k for k, name in enumerate(FORMS)}
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            form = np.array([names[f] for f in batch.column(1).to_pylist()], np.int64)
            for lo, hi in runs(off):
                out, new = restore(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], form[lo:hi])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), text_array(out, new)], names=["row", "restored"])
        trim()

    out = rows.mapInArrow(kernel, with_fields(rows.select("row").schema, restored="string"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("restored").alias(out_col))


def digests(made: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of :func:`fill_in_middle`'s rows, the restored text's among them."""
    back = restore_text(made.select(id_col, *NEW))
    return back.select(id_col, F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
                       F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p"""

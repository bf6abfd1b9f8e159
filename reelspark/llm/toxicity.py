"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct terms - words and word stems of four and five bytes - hashed
to slots.  Every slot of at least two documents of a bounded training sample carries a linear weight and
a factor vector, so that pairs of terms interact (an insult with a group mention), also where one of them
says little alone.  The fit starts from the slots most associated with the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, trim, with_fields
from .textops import U64, WordHasher, doc_chunks, text_buffer, word_spans

#: Bound on the training sample (labelled documents) and the hashed slots.
SAMPLE_DOCS = 20_000
SLOTS = 1 << 20
#: Documents from which a slot is in the machine.
MIN_DOCS = 2
#: The first fit is over at most so many slots, of at least this chi-square with the label.
FIRST_SLOTS = 4096
FIRST_CHI2 = 15.0
FACTORS = 8
EPOCHS = 30
#: Steps of the fit over all slots at least, and the terms a document from which its steps are shorter.
WHOLE_STEPS = 1200
WIDE_TERMS = 100

#: Bytes that end a word: ASCII other than letters, digits and the apostrophe.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = False
BREAK[39] = False


def doc_slots(buf: np.ndarray, off: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(document index, slot) of every term of a run of documents, repeats included."""
    starts, ends, doc = word_spans(buf, off, BREAK)
    prefix = hasher.prefix(buf)
    docs, slots = [doc], [hasher.spans(prefix, starts, ends)]
    for size in (4, 5):
        more = ends - starts > size
        docs.append(doc[more])
        slots.append(hasher.spans(prefix, starts[more], starts[more] + size) ^ U64(size))
    return np.concatenate(docs), (np.concatenate(slots) % U64(SLOTS)).astype(np.int64)


class FactorizationMachine:
    """score = w0 + sum w[i] + sum over pairs <v[i], v[j]>, trained by Adam on the logistic loss."""

    def __init__(self, slots: np.ndarray, bias: float = 0.0):
        self.slots = np.sort(slots)
        self.w0, self.w = bias, np.zeros(len(slots))
        self.v = np.random.default_rng(7).normal(0, 0.02, (len(slots), FACTORS))

    @classmethod
    def of(cls, slots: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> "FactorizationMachine":
        """The machine of these (sorted) slots and parameters."""
        out = cls.__new__(cls)
        out.slots, out.w0, out.w, out.v = slots, w0, w, v
        return out

    def widened(self, slots: np.ndarray) -> "FactorizationMachine":
        """A machine over ``slots`` (these among them): further ones start without a weight, with short vectors."""
        out = FactorizationMachine(slots, self.w0)
        out.w, out.v = out.w.astype(np.float32), (out.v / 4).astype(np.float32)
        at = np.searchsorted(out.slots, self.slots)
        out.w[at], out.v[at] = self.w, self.v
        return out

    def raw(self, doc: np.ndarray, idx: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents from their (document, kept slot) pairs, each pair once."""
        out = self.w0 + np.bincount(doc, self.w[idx], n)
        for v in self.v.T:
            x = v[idx].astype(float)
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, l2: float = 1e-4) -> None:
        rng = np.random.default_rng(3)
        state = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        mom, var, step = [a.copy() for a in state], [a.copy() for a in state], 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 512):
                part = order[k:k + 512]
                doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                idx = np.concatenate([rows[i] for i in part]).astype(np.int64)
                s = np.zeros((len(part), FACTORS))
                np.add.at(s, doc, self.v[idx])
                g = (sigmoid(self.raw(doc, idx, len(part))) - y[part]) / len(part)
                gw = np.bincount(idx, g[doc], len(self.w)) + l2 * self.w
                gv = np.zeros_like(self.v)
                np.add.at(gv, idx, g[doc, None] * (s[doc] - self.v[idx]))
                step += 1
                params = [np.array([self.w0]), self.w, self.v]
                for j, grad in enumerate((np.array([g.sum()]), gw, gv + l2 * self.v)):
                    mom[j] = 0.9 * mom[j] + 0.1 * grad
                    var[j] = 0.999 * var[j] + 0.001 * grad ** 2
                    params[j] -= rate * (mom[j] / (1 - 0.9 ** step)) / (np.sqrt(var[j] / (1 - 0.999 ** step)) + 1e-8)
                self.w0 = float(params[0][0])

    def fit_all(self, rows: list[np.ndarray], y: np.ndarray, first: np.ndarray, rate: float = 0.02,
                l1: float = 1e-3, l21: float = 3e-4, eps: float = 3e-3) -> None:
        """Adam over the slots that a batch has, with the changes since the fit of ``first`` (a mask of slots) drawn to zero.

        The large ``eps`` lets a slot move by its evidence, not by a step of fixed length, and the pull (on a
        weight, and on a vector as a whole) holds slots without evidence down.
        """
        order = np.random.default_rng(3).permutation(len(rows))
        batches = []
        for k in range(0, len(order), 512):
            part = order[k:k + 512]
            u, inv = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            sizes = [len(rows[i]) for i in part]
            if len(u):
                batches.append((part, np.repeat(np.arange(len(part), dtype=np.int32), sizes), u, inv.astype(np.int32)))
        if not batches:
            return
        rate *= min(1.0, WIDE_TERMS * len(rows) / sum(map(len, rows)))
        epochs = max(EPOCHS, -(-WHOLE_STEPS // len(batches)))
        params = np.vstack((self.w[None], self.v.T)).astype(np.float32)
        centre, mom, var = params * first.astype(np.float32), np.zeros_like(params), np.zeros_like(params)
        mom0 = var0 = 0.0
        rng, step, steps = np.random.default_rng(5), 0, epochs * len(batches)
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                part, doc, u, inv = batches[b]
                n, p = len(part), params[:, u].astype(float)
                score, sums = self.w0 + np.bincount(doc, p[0][inv], n), []
                for x in p[1:]:
                    sums.append(np.bincount(doc, x[inv], n))
                    score += 0.5 * (sums[-1] ** 2 - np.bincount(doc, (x * x)[inv], n))
                g = (sigmoid(score) - y[part]) / n
                grad = np.empty_like(p)
                grad[0] = np.bincount(inv, g[doc], len(u))
                for j, q in enumerate(sums, 1):
                    grad[j] = np.bincount(inv, (g * q)[doc], len(u)) - p[j] * grad[0]
                step += 1
                c1, c2, pace = 1 - 0.9 ** step, 1 - 0.999 ** step, rate * (1 - step / (steps + 1))
                m, v = 0.9 * mom[:, u] + 0.1 * grad, 0.999 * var[:, u] + 0.001 * grad ** 2
                mom[:, u], var[:, u] = m, v
                move = pace / (np.sqrt(v / c2) + eps)
                held = centre[:, u]
                p -= move * m / c1 + held
                p[0] = np.sign(p[0]) * np.maximum(np.abs(p[0]) - move[0] * l1, 0)
                p[1:] *= np.maximum(1 - move[1:].mean(axis=0) * l21 / (np.sqrt((p[1:] ** 2).sum(axis=0)) + 1e-12), 0)
                params[:, u] = p + held
                mom0, var0 = 0.9 * mom0 + 0.1 * g.sum(), 0.999 * var0 + 0.001 * g.sum() ** 2
                self.w0 -= pace * (mom0 / c1) / (np.sqrt(var0 / c2) + 1e-8)
        self.w, self.v = params[0], np.ascontiguousarray(params[1:].T)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def known_terms(doc: np.ndarray, slot: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, position in ``kept``) pairs."""
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(kept, slot), len(kept) - 1)
    hit = kept[at] == slot
    pairs = np.unique(doc[hit] * len(kept) + at[hit])
    return pairs // len(kept), pairs % len(kept)


def training_sample(labels: DataFrame, usable: Column, id_col: str, label_col: str, size: int) -> DataFrame:
    """At most ``size`` labelled ids, those of the smallest hash (one row an id; of several labels the greatest)."""
    rows = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("tox_id")).agg(F.max(label_col).cast("int").alias("tox_y"))
    n = rows.count()
    key = F.pmod(F.xxhash64("tox_id", F.lit(29)), F.lit(1 << 40))
    if n > size:  # thin out before the ordered limit, so that no task gathers more than about the bound
        rows = rows.where(key < int((1 << 40) * min(1.0, 1.2 * size / n)))
    return rows.orderBy(key, "tox_id").limit(size)


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> FactorizationMachine:
    """Fit on at most ``sample_docs`` labelled documents for which ``usable`` (over the labels' ids) holds.

    Terms are hashed on the executors; the slots of ``MIN_DOCS`` documents or more of the sample reach the
    driver, which fits the machine: over those of a high chi-square with the label, then over all.
    """
    sample = stored(training_sample(labels, usable, id_col, label_col, sample_docs), "tox-sample")
    rows = docs.select(F.col(id_col).alias("tox_id"), F.col(text_col).cast("string").alias("tox_text")) \
        .join(F.broadcast(sample), "tox_id").select("tox_y", "tox_text").dropDuplicates()

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(5, lower=True)
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            y = batch.column(0)
            for lo, hi in doc_chunks(off):
                doc, slot = doc_slots(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
                pairs = np.unique(doc * SLOTS + slot)
                cut = np.searchsorted(pairs, np.arange(hi - lo + 1) * SLOTS)
                yield pa.record_batch([y.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs % SLOTS, pa.int32()))],
                                      names=["y", "slots"])
        trim()

    feats = stored(rows.mapInArrow(featurise, "y int, slots array<int>"), "tox-terms")
    n, pos = feats.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    bias = float(np.log((pos + 1.0) / (n - pos + 1.0)))
    if pos == 0 or pos == n:
        return FactorizationMachine(np.zeros(0, np.int64), bias)
    a, b = F.col("a").cast("double"), F.col("n").cast("double")
    stat = n * F.pow(a * n - b * pos, F.lit(2.0)) / (b * (n - b) * float(pos) * float(n - pos))
    found = (feats.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") < n) & (F.col("n") >= MIN_DOCS)).select("slot", stat.alias("chi2")).orderBy("slot").toArrow())
    kept, chi2 = found.column("slot").to_numpy().astype(np.int64), found.column("chi2").to_numpy()
    best = np.lexsort((kept, -chi2))[:FIRST_SLOTS]
    first = np.zeros(len(kept), bool)
    first[best[chi2[best] >= FIRST_CHI2]] = True

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for slots in batch.column(1):
                s = slots.values.to_numpy()
                at = np.minimum(np.searchsorted(kept, s), max(0, len(kept) - 1))
                hits.append(at[kept[at] == s].astype(np.int32).tobytes() if len(kept) else b"")
            yield pa.record_batch([batch.column(0), pa.array(hits, pa.binary())], names=["y", "at"])

    # an order of its own: rows read back from the table come in no fixed order
    sample_rows = feats.mapInArrow(narrow, "y int, at binary").toArrow()
    sample_rows = sorted(zip(sample_rows.column("at").to_pylist(), sample_rows.column("y").to_pylist()))
    rows, y = [np.frombuffer(at, np.int32) for at, _ in sample_rows], np.array([y for _, y in sample_rows], float)
    model, place = FactorizationMachine(kept[first], bias), np.cumsum(first) - 1
    model.fit([place[r[first[r]]] for r in rows], y)
    model = model.widened(kept)
    model.fit_all(rows, y, first)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The input's columns plus ``tox_score`` (0 to 1) and ``tox_predicted`` (1 if the score is 0.5 or more).

    Only ``text_col`` enters a score, the whole of it.  Null and empty texts, and texts without a known
    term, score the base rate.  With no label, or labels of one kind only, all texts score the
    smoothed base rate.  Columns of the input that bear one of the new names are replaced.
    """
    docs = bounded_batches(docs).drop("tox_score", "tox_predicted")
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, label_col=label_col, sample_docs=sample_docs)
    at = docs.columns.index(text_col)
    # a worker reads a broadcast value once; with the kernel every task would unpickle a machine of its own
    # and hold it until a collection of cycles
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.w0, model.w, model.v))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = WordHasher(5, lower=True), FactorizationMachine.of(*shared.value)
        for batch in batches:
            buf, off = text_buffer(batch.column(at))
            out = [np.zeros(0)]
            for lo, hi in doc_chunks(off):
                doc, slot = doc_slots(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
                out.append(sigmoid(model.raw(*known_terms(doc, slot, model.slots), hi - lo)))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*batch.schema.names, "tox_score", "tox_predicted"])
        trim()

    return docs.mapInArrow(score, with_fields(docs.schema, tox_score="double", tox_predicted="int"))

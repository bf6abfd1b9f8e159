"""Hidden Markov language model.

A token's class is the word itself for the commonest words, else one of a fixed number of endings
(its last two bytes, hashed); a state emits a class, and a class its words by their smoothed counts.
So a text's probability is the exact likelihood of its class sequence under the hidden Markov
model, times each word's share of its class.

Word counts and class totals come from the whole training corpus, and so does the start: every class is
counted with what stands before and behind it in all training texts, and classes with like neighbours
prefer one state.  Every pass of Baum-Welch runs over the whole training corpus: tasks compute
expected counts of their documents, Spark adds them up, and the driver normalises a table of
bounded size.  The scaled forward recursion scores whole documents; counts of words beyond a bounded
table are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_bucket, stored
from .textops import U64, WordHasher, doc_chunks, in_sorted, mix, text_buffer, word_spans

STATES = 8
#: Words with a class of their own, endings, and words whose counts are sent to every task.
OWN_WORDS = 20_000
ENDINGS = 1024
TABLE_WORDS = 200_000
EXACT_COUNTS = 100_000
CLASSES = OWN_WORDS + ENDINGS + 1
END = CLASSES - 1
#: Full passes of Baum-Welch, and the passes of the plain fit in memory.
PASSES = 3
SAMPLE_PASSES = 15
#: For the start, a neighbour is one of the commonest words, an end, or one of a few groups of the other classes; before and behind.
NEIGHBOUR_WORDS, NEIGHBOURS = 24, 32
CLUSTER_STEPS = 25
#: Training sequences are cut into runs of this many tokens (scoring never cuts).
RUN = 128
CHUNK_BYTES = 1 << 20


class Tokens:
    """Words of a chunk: lower-case hash, ending class and document, in order."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, hasher: WordHasher):
        starts, ends, self.doc = word_spans(buf, off)
        self.hash = hasher.spans(hasher.prefix(buf), starts, ends)
        last, before = hasher.table[buf[ends - 1]], hasher.table[buf[np.maximum(ends - 2, 0)]]
        pair = last + np.where(ends - starts > 1, before, U64(0)) * U64(3)
        self.ending = (OWN_WORDS + mix(pair) % U64(ENDINGS)).astype(np.int32)
        self.n = len(off) - 1


def chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """(rows, tokens) of the text column ``at``, a bounded number of bytes at a time."""
    hasher = WordHasher(31, lower=True)
    for batch in batches:
        buf, off = text_buffer(batch.column(at))
        for lo, hi in doc_chunks(off, CHUNK_BYTES):
            yield batch.slice(lo, hi - lo), Tokens(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)


class WordTable:
    """Counts of the commonest words, sorted by hash, with their classes; and the totals."""

    def __init__(self, h: np.ndarray, count: np.ndarray, ending: np.ndarray, least: int, tokens: int, distinct: int):
        self.least = least                     # every word with this count or more is here
        rank = np.lexsort((h, -count))
        cls = ending.astype(np.int32)
        cls[rank[:OWN_WORDS]] = np.arange(min(OWN_WORDS, len(h)), dtype=np.int32)
        order = np.argsort(h)
        self.hash, self.count, self.cls = h[order], count[order], cls[order]
        self.n_tokens, self.n_distinct, self.scale = tokens, distinct, tokens + 0.1 * (distinct + 1)

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known to the table, count, class) of every word."""
        if not len(self.hash):
            return np.zeros(len(t.hash), bool), np.zeros(len(t.hash), np.int64), t.ending
        at = np.minimum(np.searchsorted(self.hash, t.hash), len(self.hash) - 1)
        known = self.hash[at] == t.hash
        return known, np.where(known, self.count[at], 0), np.where(known, self.cls[at], t.ending)


def with_ends(cls: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class sequence with an end after each document, tokens per document)."""
    sizes = np.bincount(doc, minlength=n)
    return np.insert(cls, np.cumsum(sizes), END), sizes + 1


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """``emit`` is classes x states."""
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)

    def log10_likelihood(self, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scaled forward recursion over whole sequences (concatenated in ``seq``), longest first so that a step is one slice."""
        order = np.argsort(-sizes, kind="stable")
        first, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else np.zeros(0, np.int64)
        total, a = np.zeros(len(size)), np.zeros((0, len(self.start)))
        for step, m in enumerate(alive.tolist()):
            a = (a[:m] @ self.move if step else np.broadcast_to(self.start, (m, len(self.start)))) * self.emit[seq[first[:m] + step]]
            # probabilities of ten tokens stay far from underflow; every sequence is rescaled at its end too
            ending = alive[step + 1] if step + 1 < len(alive) else 0
            lo = 0 if step % 10 == 9 else ending
            if lo < m:
                s = a[lo:].sum(axis=1)
                total[lo:m] += np.log10(s)
                a[lo:] /= s[:, None]
        out = np.zeros(len(size))
        out[order] = total
        return out

    def expected_counts(self, seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over runs: expected starts, moves and emissions (classes x states)."""
        k = len(self.start)
        pieces = -(-sizes // RUN)
        first = np.repeat(np.cumsum(sizes) - sizes, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(RUN, np.repeat(sizes, pieces) - nth * RUN)
        order = np.argsort(-size, kind="stable")
        first, size = (first + nth * RUN)[order], size[order]
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        if not len(size):
            return starts, moves, emits
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right").tolist()
        cls, b, alpha, scale = [], [], [], []
        for step, m in enumerate(alive):
            c = seq[first[:m] + step]
            e = self.emit[c]
            a = (alpha[-1][:m] @ self.move if step else self.start) * e
            s = a.sum(axis=1, keepdims=True)
            cls.append(c), b.append(e), alpha.append(a / s), scale.append(s)
        beta, gammas = np.ones((alive[-1], k)), [None] * len(alive)
        for step in range(len(alive) - 1, -1, -1):
            m = alive[step]
            if step + 1 < len(alive):
                nxt = alive[step + 1]
                weighted = b[step + 1] * beta / scale[step + 1]
                moves += alpha[step][:nxt].T @ weighted
                beta = np.concatenate((weighted @ self.move.T, np.ones((m - nxt, k))))
            g = alpha[step] * beta
            gammas[step] = g / g.sum(axis=1, keepdims=True)
        starts += gammas[0].sum(axis=0)
        del b, alpha, scale, beta
        c, g = np.concatenate(cls), np.concatenate(gammas)
        del cls, gammas
        for s in range(k):
            emits[:, s] = np.bincount(c, g[:, s], CLASSES)
        return starts, moves * self.move, emits

    @staticmethod
    def from_counts(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray) -> "Hmm":
        """Normalised counts; ``base`` (class probabilities) smooths the emissions."""
        start, move, emit = starts + 0.1, moves + 0.1, emits + base[:, None]
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def sample_fit(seq: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> Hmm:
    """Baum-Welch in memory, from random states for whole documents that tend to stay (a plain version to compare with; no query uses it)."""
    rng = np.random.default_rng(12)
    share = np.repeat(rng.dirichlet(np.full(STATES, 0.3), len(sizes)), sizes, axis=0)
    emits = np.stack([np.bincount(seq, share[:, s], CLASSES) for s in range(STATES)], axis=1)
    model = Hmm.from_counts(np.ones(STATES), np.eye(STATES) * 50 + 1, emits, base)
    for _ in range(SAMPLE_PASSES):
        model = Hmm.from_counts(*model.expected_counts(seq, sizes), base)
    return model


def neighbour_cells(seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cells (class times 2 * NEIGHBOURS plus column) of every token's neighbours before and behind it in its document."""
    group = np.where(seq < NEIGHBOUR_WORDS, seq, np.where(seq == END, NEIGHBOURS - 1, NEIGHBOUR_WORDS + seq % (NEIGHBOURS - 1 - NEIGHBOUR_WORDS)))
    inner = np.ones(len(seq), bool)          # has a token behind it
    inner[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inner)
    seq, width = seq.astype(np.int64), 2 * NEIGHBOURS
    return np.concatenate((seq[at + 1] * width + group[at], seq[at] * width + NEIGHBOURS + group[at + 1]))


def start_fit(cells: np.ndarray, count: np.ndarray, base: np.ndarray) -> Hmm:
    """A model whose states tend to stay and prefer classes with like neighbours, from the counts of :func:`neighbour_cells`."""
    width = 2 * NEIGHBOURS
    table = np.bincount(cells, count, CLASSES * width).reshape(CLASSES, width)
    x, weight = np.sqrt(table), table.sum(axis=1)
    x /= np.maximum(np.sqrt(weight), 1.0)[:, None]
    # k-means of the classes by their occurrences, from the commonest one and then those farthest from all centres
    centre, far = np.zeros((STATES, width)), weight.copy()
    gap = np.full(CLASSES, np.inf)
    for s in range(STATES):
        centre[s] = x[np.argmax(far)]
        gap = np.minimum(gap, ((x - centre[s]) ** 2).sum(axis=1))
        far = weight * gap
    for _ in range(CLUSTER_STEPS):
        own = np.argmin((centre ** 2).sum(axis=1) - 2 * x @ centre.T, axis=1)
        for s in range(STATES):
            mass = weight * (own == s)
            if mass.any():
                centre[s] = mass @ x / mass.sum()
    distance = (x ** 2).sum(axis=1)[:, None] + (centre ** 2).sum(axis=1) - 2 * x @ centre.T
    near = np.exp(-8 * (distance - distance.min(axis=1, keepdims=True))) + 0.02
    emits = near / near.sum(axis=1, keepdims=True) * weight[:, None]
    return Hmm.from_counts(np.ones(STATES), np.eye(STATES) * 50 + 1, emits, base)


def count_words(docs: DataFrame) -> DataFrame:
    """``h, ending, n``: count of every distinct word of the text column (hash of its lower-case form)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in chunks(batches, 0):
            h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(t.ending[first]), pa.array(n)], names=["h", "ending", "n"])

    return docs.mapInArrow(count, "h long, ending int, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, n_docs: int, table_words: int = TABLE_WORDS) -> tuple[WordTable, np.ndarray, np.ndarray]:
    """(table of the commonest words, ``table_words`` at most, tokens and distinct words per ending outside the words of their own)."""
    # words by count; counts over EXACT_COUNTS share a line with those within a thousandth of an octave, so the lines are few
    line = F.when(F.col("n") <= EXACT_COUNTS, F.col("n")).otherwise(EXACT_COUNTS + F.floor(F.log2("n") * 1000))
    by_count = counts.groupBy(line.alias("line")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
    total, distinct = sum(r.tokens for r in by_count) + n_docs, sum(r.words for r in by_count) + (n_docs > 0)
    least, held = 1 << 62, 0
    for r in sorted(by_count, key=lambda r: -r.n):   # whole lines only: ties share a fate
        held += r.words
        if held > table_words:
            break
        least = r.n
    rows = counts.where(F.col("n") >= least).toArrow()
    table = WordTable(rows.column("h").to_numpy().view(U64), rows.column("n").to_numpy(), rows.column("ending").to_numpy(), least, total, distinct)
    per = {r.ending: r for r in counts.groupBy("ending").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for e, r in per.items():
        tokens[e - OWN_WORDS], words[e - OWN_WORDS] = r.t, r.v
    ending = dict(zip(rows.column("h").to_numpy().view(U64).tolist(), rows.column("ending").to_numpy().tolist()))
    own = table.cls < OWN_WORDS
    for h, n in zip(table.hash[own].tolist(), table.count[own].tolist()):
        tokens[ending[h] - OWN_WORDS] -= n
        words[ending[h] - OWN_WORDS] -= 1
    return table, tokens, words


def train(docs: DataFrame, text_col: str, counts: DataFrame, n_docs: int) -> tuple[WordTable, np.ndarray, Hmm]:
    """(word table, log10 of each ending's denominator, model) from training rows."""
    table, tokens, words = word_table(counts, n_docs)
    base = np.concatenate((np.zeros(OWN_WORDS), tokens, [float(n_docs)])) + 0.1
    own = table.cls < OWN_WORDS
    base[table.cls[own]] += table.count[own]
    base /= base.sum()

    def classes(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, t in chunks(batches, at):
            yield with_ends(table.look_up(t)[2], t.doc, t.n)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * 2 * NEIGHBOURS, np.int64)
        for seq, sizes in classes(batches, 0):
            cell, n = np.unique(neighbour_cells(seq, sizes), return_counts=True)
            total[cell] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    cells = texts.mapInArrow(neighbours, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    model = start_fit(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), base)

    names = [f"s{k}" for k in range(STATES)]
    for _ in range(PASSES if n_docs else 0):
        def expect(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            """One row a class and task, then those of the moves (numbered on) and of the starts."""
            total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
            for seq, sizes in classes(batches, 0):
                for t, x in zip(total, model.expected_counts(seq, sizes)):
                    t += x
            rows = np.concatenate((total[2], total[1], total[0][None]))
            at = np.flatnonzero(rows.any(axis=1))
            yield pa.record_batch([pa.array(at, pa.int32()), *[pa.array(rows[at, k]) for k in range(STATES)]], names=["row", *names])

        added = texts.mapInArrow(expect, "row int, " + ", ".join(f"{n} double" for n in names)) \
            .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        rows = np.zeros((CLASSES + STATES + 1, STATES))
        rows[added.column("row").to_numpy()] = np.stack([added.column(n).to_numpy() for n in names], axis=1)
        model = Hmm.from_counts(rows[-1], rows[CLASSES:-1], rows[:CLASSES], base)
    return table, np.log10(tokens + 0.1 * (words + 1)), model


def score_documents(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by a hidden Markov model learnt from the rows where ``usable`` holds.

    Returns ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed unigram) and
    ``score`` (model), both log10 probabilities of the text and its end, one row per input row.  A null
    or empty text is its end alone.  Without training rows every token is unknown.  Words are told
    apart by 64-bit hashes.  Other columns are not kept; an empty table gives an empty one.
    """
    train_rows = bounded_batches(docs).where(usable)
    text = F.col(text_col).cast("string").alias("text")
    n_docs = train_rows.count()
    counts = stored(count_words(train_rows.select(text)), "lm-counts")
    table, per_ending, model = train(train_rows, text_col, counts, n_docs)
    scale = np.log10(table.scale)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document (ending -1) with what is known here, and a row for each of its other words."""
        for rows, t in chunks(batches, 2):
            known, count, cls = table.look_up(t)
            seq, sizes = with_ends(cls, t.doc, t.n)
            weight = np.log10(count + 0.1)
            base = np.bincount(t.doc[known], weight[known], t.n) - scale * (sizes - np.bincount(t.doc[~known], minlength=t.n)) + np.log10(n_docs + 0.1)
            part = cls >= OWN_WORDS
            inner = np.where(known, weight, 0.0) - per_ending[np.where(part, cls - OWN_WORDS, 0)]
            total = model.log10_likelihood(seq, sizes) + np.bincount(t.doc[part], inner[part], t.n)
            uid, ids = rows.column(0), rows.column(1)
            n = t.n
            yield pa.record_batch([uid, ids, pa.array(mix(np.arange(n, dtype=U64)).view(np.int64)), pa.array(np.full(n, -1), pa.int32()),
                                   pa.array(sizes.astype(np.int64)), pa.array(np.bincount(t.doc[known], minlength=n).astype(np.int64) + (n_docs > 0)),
                                   pa.array(base), pa.array(total)], names=names)
            other = ~known
            doc, h, ending = t.doc[other], t.hash[other], t.ending[other]
            order = np.lexsort((h, doc))
            doc, h, ending = doc[order], h[order], ending[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(doc)))
            take = pa.array(doc[first])
            z = np.zeros(len(times))
            yield pa.record_batch([uid.take(take), ids.take(take), pa.array(h[first].view(np.int64)), pa.array(ending[first]),
                                   pa.array(times.astype(np.int64)), pa.array(np.zeros(len(times), np.int64)), pa.array(z), pa.array(z)], names=names)

    names = ["uid", "id", "h", "ending", "n", "known", "base", "total"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text)
    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = rows.mapInArrow(score, f"uid long, id {id_type}, h long, ending int, n long, known long, base double, total double")
    rare = counts.where(F.col("n") < table.least).select("h", "ending", F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    is_doc = F.col("ending") == -1
    gain = F.col("n") * F.log10(c + F.lit(0.1))
    return (pieces.join(rare, ["h", "ending"], "left")
            .groupBy("uid").agg(
                F.max("id").alias(id_col), F.sum(F.when(is_doc, F.col("n")).otherwise(0)).alias("n_tokens"),
                F.sum(F.when(is_doc, F.col("known")).when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
                F.sum(F.when(is_doc, F.col("base")).otherwise(gain - F.col("n") * F.lit(float(scale)))).alias("base_score"),
                F.sum(F.when(is_doc, F.col("total")).otherwise(gain)).alias("score"))
            .select(id_col, "n_tokens", "n_known", F.lit(int(table.n_tokens)).cast("long").alias("train_tokens"), "base_score", "score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose ``crc32(id as text) mod 10`` is 0."""
    return id_bucket(F.col(id_col), 10) == 0

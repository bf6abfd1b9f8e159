"""MinHash near-duplicates with ProbMinHash signatures.

A document is its bag of five-word shingles, weighted by their counts.  Every shingle is the source of
a Poisson process of arrivals at the rate of its weight (exponential steps hashed from the shingle),
and each arrival falls into one of the signature's registers; a register keeps the shingle that
arrives first.  Drawing stops for a shingle as soon as its next arrival is later than all registers
of its document.  Two documents agree in a register with the probability of their probability
Jaccard similarity.  Bands of registers propose candidates, and the similarity of each candidate
pair is computed from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, once, stored, trim
from .components import components
from .textops import U64, WordHasher, doc_chunks, mix, text_buffer, window_hashes, word_spans

SHINGLE = 5
#: 25 bands of 5 registers: a pair at similarity 0.8 is proposed with probability 0.99995, one at 0.3 with 0.06.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Slots in which shingles are counted to order them by rarity.
SLOTS = 1 << 20

#: Repeated ids up to which their list is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def chunk_words(buf: np.ndarray, off: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, doc = word_spans(buf, off)
    return hasher.spans(hasher.prefix(buf), starts, ends), doc


def shingles(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), by document; a document of 1 to 4 words is one shingle of all its words."""
    size = np.bincount(doc, minlength=n)
    end = np.cumsum(size)
    at = np.arange(max(0, len(h) - SHINGLE + 1))
    whole = at[at + SHINGLE <= end[doc[at]]]
    docs, hashes = [doc[whole]], [window_hashes(h, SHINGLE)[whole]]
    for length in range(1, SHINGLE):
        short = np.flatnonzero(size == length)
        if len(short):
            first = end[short] - length
            acc = np.full(len(short), length, U64)
            for k in range(length):
                acc = mix(acc * U64(0x9E3779B97F4A7C15) + h[first + k])
            docs.append(short)
            hashes.append(acc)
    d, s = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash: n x REGISTERS shingle hashes (all zero for a document without words)."""
    out = np.zeros((n, REGISTERS), U64)
    best = np.full(n * REGISTERS, np.inf)
    flat = out.reshape(-1)
    alive, x, step = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(alive):
        step += 1
        r = mix(shingle[alive] + U64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        x = x - np.log((np.float64(1) + (r >> U64(11))) / 2.0**53) / weight[alive]
        reg = doc[alive] * REGISTERS + (mix(r) % U64(REGISTERS)).astype(np.int64)
        np.minimum.at(best, reg, x)
        won = best[reg] == x
        flat[reg[won]] = shingle[alive[won]]
        limit = best.reshape(n, REGISTERS).max(axis=1)
        keep = x < limit[doc[alive]]
        alive, x = alive[keep], x[keep]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        acc = mix(acc * U64(0xD1342543DE82EF95) + part[:, :, k])
    return acc


def content_hash(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's word sequence."""
    size = np.bincount(doc, minlength=n)
    end = np.cumsum(size)
    place = (np.arange(len(h)) - (end - size)[doc]).astype(U64) if len(h) else np.zeros(0, U64)
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        c = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + mix(place * U64(salt) + U64(salt))), dtype=U64)))
        out.append(mix(c[end] - c[end - size] + size.astype(U64)))
    return out[0], out[1]


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    keys = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(keys)), np.zeros(len(keys))
    wa[np.searchsorted(keys, a[0])] = a[1]
    wb[np.searchsorted(keys, b[0])] = b[1]
    pairs, times = np.unique(np.stack((wa, wb)), axis=1, return_counts=True)
    total = 0.0
    for x, y, t in zip(*pairs, times):
        if x and y:
            total += t / (times * np.maximum(pairs[0] / x, pairs[1] / y)).sum()
    return total


def weighted_sets(buf: np.ndarray, off: np.ndarray, hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    h, doc = chunk_words(buf, off, hasher)
    d, s, w = shingles(h, doc, len(off) - 1)
    cut = np.searchsorted(d, np.arange(len(off)))
    for lo, hi in zip(cut, cut[1:]):
        yield s[lo:hi], w[lo:hi]


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(lower=True)
    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        for lo, hi in doc_chunks(off, 1 << 20):
            h, doc = chunk_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
            n = hi - lo
            keys = bands(signatures(*shingles(h, doc, n), n)).view(np.int64)
            c1, c2 = content_hash(h, doc, n)
            cut = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
            empty = np.bincount(doc, minlength=n) == 0
            yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(c1.view(np.int64), mask=empty), pa.array(c2.view(np.int64), mask=empty),
                                   pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))], names=["id", "c1", "c2", "bands"])
    trim()


def similar(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            (buf_a, off_a), (buf_b, off_b) = text_buffer(batch.column(2)), text_buffer(batch.column(3))
            keep = []
            for k in range(batch.num_rows):
                one, = weighted_sets(buf_a[off_a[k]:off_a[k + 1]], off_a[k:k + 2] - off_a[k], hasher)
                two, = weighted_sets(buf_b[off_b[k]:off_b[k + 1]], off_b[k:k + 2] - off_b[k], hasher)
                keep.append(probability_jaccard(one, two) >= threshold)
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return check


def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the texts the shingles of each slot occur."""
    hasher, total = WordHasher(lower=True), np.zeros(SLOTS, np.int64)
    for batch in batches:
        buf, off = text_buffer(batch.column(2))
        for lo, hi in doc_chunks(off, 1 << 20):
            h, doc = chunk_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
            total += np.bincount((shingles(h, doc, hi - lo)[1] % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])


def rare_prefixes(often: np.ndarray, threshold: float):
    """For each text its rarest shingles up to the weight that a match may lack, with what comes before each."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            buf, off = text_buffer(batch.column(2))
            for lo, hi in doc_chunks(off, 1 << 20):
                h, doc = chunk_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
                d, s, w = shingles(h, doc, hi - lo)
                order = np.lexsort((s, often[(s % U64(SLOTS)).astype(np.int64)], d))
                d, s, w = d[order], s[order], w[order]
                size, weight = np.bincount(d, minlength=hi - lo), np.bincount(d, w, hi - lo)
                first = np.cumsum(size) - size
                before = np.cumsum(w) - w
                before = before - np.concatenate((before, [0]))[first][d]
                at = np.flatnonzero(before <= (1 - threshold) * weight[d] + 1e-9)
                take = pa.array(d[at] + lo)
                yield pa.record_batch([pa.array(s[at].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(weight[d[at]]),
                                       pa.array(size[d[at]].astype(np.float64)), pa.array(before[at].astype(np.float64)),
                                       pa.array((at - first[d[at]]).astype(np.float64))],
                                      names=["s", "id", "grp", "weight", "size", "before_w", "before_n"])
    return prefixes


def open_pairs(open_docs: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs ``a, b`` of different groups among ``id, grp, text``; none at or above the threshold is missed.

    A pair at probability Jaccard ``t`` shares shingles of at least ``t`` of either text's weight, so the
    first shared one in a global order (rarest first) lies in both texts' prefixes of weight
    ``1 - t``.  What precedes it in either text is not shared; that, and the texts' sizes, bound the
    similarity from above, and only pairs whose bound reaches ``t`` go on.
    """
    counted = open_docs.select("id", "grp", "text").mapInArrow(slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    entries = open_docs.select("id", "grp", "text").mapInArrow(
        rare_prefixes(often.astype(np.int32), threshold),
        "s long, id long, grp long, weight double, size double, before_w double, before_n double")

    def side(mark: str) -> DataFrame:
        return entries.select(*[F.col(c).alias(c + mark) for c in ("s", "id", "grp", "weight", "size", "before_w", "before_n")])

    a, b = side("_a"), side("_b")
    miss_a = F.greatest("before_w_a", F.col("size_a") - F.col("size_b") + F.col("before_n_b")) / F.col("weight_a")
    miss_b = F.greatest("before_w_b", F.col("size_b") - F.col("size_a") + F.col("before_n_a")) / F.col("weight_b")
    bound = (1 - miss_a) * (1 - miss_b) / ((1 - miss_b) + miss_b * (1 - miss_a))
    return a.join(b, (F.col("s_a") == F.col("s_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("grp_a") != F.col("grp_b"))
                  & (miss_a < 1) & (miss_b < 1) & (bound >= threshold - 1e-9)) \
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``class_id`` (least id of its near-duplicate group), ``kept`` and ``copy_of``.

    ``kept`` is true for the least id of a group; ``copy_of`` is the least id with the same words (itself
    if none).  Words are taken in lower case (A-Z).  Null and empty texts link with nothing and are kept;
    texts of 1 to 4 words are one shingle, so only equal ones link.  A null id links with nothing and is
    kept.  Rows that share an id and a text are one; texts that share an id are different documents, whose class is named by the
    least id as any, and of which the one with the least hash counts as the lesser.  An empty table gives an empty one.

    Copies are one candidate.  Members of a band bucket are first compared with the bucket's least id
    only.  The members of buckets that then still hold several groups are searched exactly, for links
    between groups (see :func:`open_pairs`), so no link that would join two groups is lost, and a large
    group of near copies costs about a pair a member.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    again = stored(rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("again")), "near-again")
    n = again.count()
    if not n:
        return unique_near_duplicates(rows, threshold).withColumnsRenamed({"id": id_col})
    # texts of a repeated id get a number of their own, and the least id of a class is found afterwards
    rows = rows.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("id") == F.col("again"), "left") \
        .select(F.col("id").alias("real"), F.when(F.col("again").isNotNull(), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("id"), "text")
    found = stored(unique_near_duplicates(rows.select("id", "text"), threshold), "near-found")
    names = rows.where("id IS NOT NULL").select("id", "real").distinct()
    told = found.where("id IS NOT NULL").select("id", "class_id", "copy_of").distinct().join(names, "id")
    classes = told.groupBy("class_id").agg(F.min(F.struct("real", "id")).alias("least"))
    copies = told.groupBy("copy_of").agg(F.min("real").alias("copy_real"))
    told = told.join(classes, "class_id").join(copies, "copy_of").select(
        "id", "real", F.col("least.real").alias("class_real"), (F.col("least.id") == F.col("id")).alias("kept"), "copy_real")
    out = found.select("id").join(told, "id", "left")
    return out.select(F.col("real").alias(id_col), F.col("class_real").alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"),
                      F.col("copy_real").alias("copy_of"))


def unique_near_duplicates(rows: DataFrame, threshold: float) -> DataFrame:
    """:func:`near_duplicates` of ``id, text`` rows in which an id has one text."""
    bounded_batches(rows)
    signed = stored(rows.where("id IS NOT NULL").mapInArrow(sign, "id long, c1 long, c2 long, bands array<bigint>"), "near-signatures")
    classes = stored(signed.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")),
                     "near-classes")
    entries = classes.select("rep", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    members = stored(entries.join(buckets.select("band", "lead"), "band"), "near-members")

    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = stored(rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")), "near-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a"), "a") \
            .join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "text_b"), "b") \
            .select("a", "b", "text_a", "text_b").mapInArrow(similar(threshold), "a long, b long")

    first = stored(verified(members.where("lead < rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()), "near-links")
    comp = components(first, "a", "b", "near-components")
    grouped = stored(members.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                     .select("band", "lead", "rep", F.coalesce("component", "rep").alias("grp")), "near-grouped")
    mixed = grouped.groupBy("band").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 < g2").select("band")
    open_docs = stored(grouped.join(mixed, "band", "left_semi").select(F.col("rep").alias("id"), "grp").distinct().join(texts, "id"), "near-open")
    more = stored(verified(open_pairs(open_docs, threshold)), "near-links")
    # the further links join whole groups, whose least ids stand for them
    group = open_docs.select("id", "grp")
    joined = components(more.join(group.withColumnsRenamed({"id": "a", "grp": "grp_a"}), "a").join(group.withColumnsRenamed({"id": "b", "grp": "grp_b"}), "b"),
                        "grp_a", "grp_b", "near-components")
    final = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left") \
        .select("node", F.coalesce("least", "component").alias("component")) \
        .unionAll(joined)      # no least id of a group is a node of ``comp``

    copies = signed.where("c1 IS NOT NULL").select("id", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]) \
        .select("id", "rep").unionAll(signed.where("c1 IS NULL").select("id", F.col("id").alias("rep"))) \
        .groupBy("id").agg(F.min("rep").alias("rep"))
    placed = copies.join(final.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("id", "rep", F.coalesce("component", "rep").alias("class_id"))
    out = rows.select(F.col("id").alias("doc")).join(placed, F.col("doc") == F.col("id"), "left")
    return out.select(F.col("doc").alias("id"), F.coalesce("class_id", "doc").alias("class_id"),
                      F.coalesce(F.col("class_id") == F.col("doc"), F.lit(True)).alias("kept"), F.coalesce("rep", "doc").alias("copy_of"))


def drop_near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that are not ``kept`` (see :func:`near_duplicates`); of rows with one id and one text one stays.

    Of several texts of one id that are near copies of each other all stay or go together, as their class does.
    """
    gone = near_duplicates(docs, threshold=threshold, id_col=id_col, text_col=text_col) \
        .groupBy(F.col(id_col).alias("near_gone")).agg(F.max("kept").alias("stays")).where("NOT stays").select("near_gone")
    return once(docs.join(gone, docs[id_col] == gone["near_gone"], "left_anti"), id_col, text_col)

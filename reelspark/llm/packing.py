"""Best-fit packing: minimum bin slack.

Documents become token ids; those longer than a sequence are cut into whole pieces.  The short
pieces are dealt over partitions by a hash, and each partition fills its sequences one by one: the
longest piece left opens the sequence, a subset-sum over a bitset of the lengths still available
finds the fullest combination, and that combination is removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, process_cache, trim
from .textops import U64, WordHasher, doc_chunks, in_sorted, text_buffer, word_spans

CAPACITY = 4096
#: Documents a packing partition takes on average; each partition ends with at most one loose sequence.
DOCS_PER_PART = 8192
#: Words whose ids a Python worker remembers (a speed-up only; the rarer half is forgotten when full).
CACHE_WORDS = 700_000


class WordEncoder:
    """Token ids of whole texts, several documents at a time.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of its
    white-space-separated words one after another.  The ids of words seen before are kept in a table
    sorted by word hash; a chunk's distinct words are looked up together, and only the new ones are
    encoded.  The table lives as long as the worker; when full it keeps its commonest half.
    """

    def __init__(self, path: str):
        self.hasher = WordHasher(23)
        self.state = process_cache("word_ids:" + path)
        if not self.state:
            from tokenizers import Tokenizer
            self.state["tok"] = Tokenizer.from_file(path)
            self.state["table"] = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            self.state["pool"] = np.zeros(0, "<u4")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of a list of words, many in one text; a token is of the word its offset lies in."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 4000):
            part = [w.decode("utf-8", "replace") for w in words[k:k + 4000]]
            enc = self.state["tok"].encode(" ".join(part), add_special_tokens=False)
            first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)))
            at = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc))
            sizes.append(np.diff(np.searchsorted(at, first)))
            ids.append(np.asarray(enc.ids, "<u4"))
        return np.concatenate(ids), np.concatenate(sizes)

    def look_up(self, uniq: np.ndarray, times: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of distinct word hashes; ``word(k)`` gives the bytes of the k-th."""
        keys, start, size, used = self.state["table"]
        new = np.flatnonzero(~in_sorted(uniq, keys))
        if len(new):
            if len(keys) > CACHE_WORDS:
                keep = used >= max(2, int(np.median(used)) + 1)
                order = np.repeat(start[keep] - (np.cumsum(size[keep]) - size[keep]), size[keep]) + np.arange(size[keep].sum())
                self.state["pool"] = self.state["pool"][order]
                keys, size, used = keys[keep], size[keep], used[keep]
                start = np.cumsum(size) - size
                new = np.flatnonzero(~in_sorted(uniq, keys))
            ids, sizes = self.encode_words([word(k) for k in new.tolist()])
            at = np.searchsorted(keys, uniq[new])
            places = len(self.state["pool"]) + np.cumsum(sizes) - sizes
            keys, start = np.insert(keys, at, uniq[new]), np.insert(start, at, places)
            size, used = np.insert(size, at, sizes), np.insert(used, at, 0)
            self.state["pool"] = np.concatenate((self.state["pool"], ids))
        at = np.searchsorted(keys, uniq)
        used[at] += times
        self.state["table"] = keys, start, size, used
        return start[at], size[at]

    def documents(self, buf: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each with the end id after it; ids per document) of a run of documents."""
        starts, ends, doc = word_spans(buf, off)
        h = self.hasher.spans(self.hasher.prefix(buf), starts, ends)
        uniq, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        place, size = self.look_up(uniq, times, lambda k: buf[starts[first[k]]:ends[first[k]]].tobytes())
        n = size[inverse]
        ids = self.state["pool"][np.repeat(place[inverse] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        per_doc = np.bincount(doc, n, len(off) - 1).astype(np.int64)
        return np.insert(ids, np.cumsum(per_doc), end_id), per_doc + 1


def fill_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum bin slack over one partition: (bin number, offset in the bin) of every length (1..capacity).

    ``reach[t]`` are the sums that the first ``t`` lengths offered can make, one bit each; a length
    with several pieces left is offered as often as it can be used.  The search stops at the first
    exact fill; else the fullest sum is taken and traced back.
    """
    order = np.argsort(-lengths, kind="stable")
    have = np.bincount(lengths, minlength=capacity + 1)
    ends = np.cumsum(have[::-1])[::-1]             # rows of ``order`` per length: [ends - have, ends)
    have, ends = have.tolist(), ends.tolist()
    bins, offs, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    alive = [v for v in range(capacity, 0, -1) if have[v]]
    full_mask = (1 << (capacity + 1)) - 1
    while alive:
        top = alive[0]
        chosen, room = [top], capacity - top
        have[top] -= 1
        if room:
            mask, goal = full_mask >> top, 1 << room
            reach, steps, used = 1, [], []
            for v in alive:
                if v > room:
                    continue
                for _ in range(min(have[v], room // v)):
                    nxt = (reach | (reach << v)) & mask
                    if nxt == reach:
                        break
                    steps.append(reach)
                    used.append(v)
                    reach = nxt
                    if reach & goal:
                        break
                if reach & goal:
                    break
            at = reach.bit_length() - 1
            for before, v in zip(reversed(steps), reversed(used)):
                if not (before >> at) & 1:
                    chosen.append(v)
                    have[v] -= 1
                    at -= v
        place = 0
        for v in chosen:
            ends[v] -= 1
            row = order[ends[v]]
            bins[row], offs[row] = n_bins, place
            place += v
        n_bins += 1
        if not all(have[v] for v in chosen):
            gone = {v for v in chosen if not have[v]}
            alive = [v for v in alive if v not in gone]
    return bins, offs


PIECE_SCHEMA = "pack_id long, piece int, start long, length long, ids_crc32 long, part long"
PLACE_SCHEMA = "pack_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_best_fit(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, end_id: int = 1, docs_per_part: int = DOCS_PER_PART) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as it can.

    A document is its text's ids, then ``end_id`` (a null or empty text: ``end_id`` alone).  Only longer
    ones are cut, into pieces of ``capacity``.  Returns per piece: ``id_col``, ``piece`` (int from 0),
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``; other columns are not kept.  Rows
    with equal ids are separate documents; a null id stays null.  An empty table gives an empty one.

    One shuffle of narrow rows (a piece's length, never its text).  The number of partitions follows
    the number of documents; every partition may leave one sequence part empty, nothing else differs
    from packing the whole.
    """
    n = bounded_batches(docs).count()
    parts = max(1, -(-n // docs_per_part))
    rows = docs.select(F.col(id_col).cast("long").alias("pack_id"), F.col(text_col).cast("string").alias("pack_text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer_path)
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for lo, hi in doc_chunks(off):
                ids, sizes = enc.documents(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], end_id)
                raw, at, out = memoryview(ids.astype("<u4")).cast("B"), 0, []
                for doc, total in zip(doc_ids[lo:hi], sizes.tolist()):
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(raw[4 * (at + start):4 * (at + start + length)])
                        # spread by content and place, not by id alone: repeated ids do not meet in one partition
                        out.append((doc, piece, start, length, crc, zlib.crc32(b"%d:%d:%d" % (doc or 0, piece, crc)) % parts))
                    at += total
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                       *[pa.array(c, pa.int64()) for c in cols[2:]]],
                                      names=["pack_id", "piece", "start", "length", "ids_crc32", "part"])
        trim()

    def place(table: pa.Table) -> pa.Table:
        # Spark hands over a group's rows in any order: sort, so that a retried task places alike
        table = table.sort_by([("length", "descending"), ("pack_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offs = fill_bins(lengths, capacity)
        part = table.column("part")[0].as_py()
        seq = bins * parts + part
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(seq, pa.int64())) \
                    .append_column("offset", pa.array(offs, pa.int64()))

    cut = rows.mapInArrow(pieces, PIECE_SCHEMA)
    return cut.groupBy("part").applyInArrow(place, PLACE_SCHEMA).withColumnRenamed("pack_id", id_col)

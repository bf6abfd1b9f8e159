"""Language identification by compression.

Each language gets a raw-content zstandard dictionary from a bounded sample of its labelled texts.  A
text's code length under a language is the compressed size of all its chunks, in bits, plus the
code length of the language itself (minus log2 of its share); the shortest wins, and a narrow
margin is a rejection.  The margin is the winner's lead over short pieces of the text, less what single
pieces have against it, as a part of the code length; how narrow is too narrow is set from labelled rows held out of the
dictionaries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_bucket, trim, with_fields

#: Bound on the training sample: documents a language, and characters of each (a hash-placed window).
SAMPLE_DOCS = 400
SAMPLE_CHARS = 300
DICT_BYTES = 64_000
#: Chunks keep the dictionary, not the text's own past, decisive.
CHUNK = 1024
#: The margin is judged over shorter pieces, so that passages in another language show.
PIECE = 256
#: Lead in bits under which a text is rejected, and the relative lead under which it is measured again
#: by the finer search.
MIN_MARGIN_BITS = 1.0
RECHECK = 0.08
#: One in so many training rows of a language with this many rows is held out of the dictionary; of these
#: so many set the margin: this part of the margin that 95 in a hundred of the rightly named reach.
HELD_ONE_IN, HELD_FROM, HELD_DOCS = 8, 64, 300
MARGIN_PART, MARGIN_QUANTILE = 0.4, 0.05
#: Rightly named rows from which a language sets its own margin, and the margin at least, which junk
#: stays under.
HELD_ENOUGH = 30
LEAST_MARGIN = 0.02
#: Scale of the score: a lead of 8 bits counts as two to one.
SCORE_SCALE = 0.125

UNDETERMINED = "und"


def train(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[dict[str, tuple[bytes, float]], dict[str, float]]:
    """Per language: dictionary content and code length of the language in bits; and the least margin.

    Learns from rows where ``usable`` holds, text and language are not null.  The sample is the
    ``sample_docs`` rows of each language with the smallest id hash: chosen by a narrow first pass
    (top rows per language, limited before the shuffle), read in a second.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("lid_id"), F.col(lang_col).cast("string").alias("lid_lang"),
                       F.col(text_col).cast("string").alias("lid_text")) \
               .withColumn("lid_hash", F.xxhash64(F.coalesce("lid_id", F.lit("")), F.lit(17)))
    shares = {r[0]: r[1] for r in rows.groupBy("lid_lang").count().collect()}  # one row a language
    if not shares:
        return {}, {}
    large = [lang for lang, n in shares.items() if n >= HELD_FROM]
    rows = rows.withColumn("lid_held", F.col("lid_lang").isin(large) & (F.pmod(F.shiftright("lid_hash", 23), F.lit(HELD_ONE_IN)) == 0))
    top = Window.partitionBy("lid_lang", "lid_held").orderBy("lid_hash")
    chosen = (rows.select("lid_lang", "lid_held", "lid_hash").withColumn("lid_rank", F.row_number().over(top))
              .where(F.col("lid_rank") <= max(sample_docs, HELD_DOCS))     # a constant: limits before the shuffle
              .where(F.col("lid_rank") <= F.when(F.col("lid_held"), HELD_DOCS).otherwise(sample_docs))
              .groupBy("lid_lang", "lid_held").agg(F.max("lid_hash").alias("lid_cut")))
    cuts = {(r[0], r[1]): r[2] for r in chosen.collect()}
    keep, check = F.lit(False), F.lit(False)
    for (lang, held), cut in cuts.items():
        one = (F.col("lid_lang") == lang) & (F.col("lid_held") == held) & (F.col("lid_hash") <= cut)
        keep, check = (keep, check | one) if held else (keep | one, check)
    start = F.pmod(F.shiftright("lid_hash", 7), F.greatest(F.lit(1), F.length("lid_text") - sample_chars)).cast("int") + 1
    window = F.lower(F.col("lid_text").substr(start, F.lit(sample_chars)))
    sample = rows.where(keep).select("lid_lang", "lid_hash", window.alias("lid_window")).distinct() \
        .orderBy("lid_hash", "lid_window").limit(sample_docs * len(cuts)).collect()
    total = sum(shares.values())
    out = {}
    for lang in sorted(shares):
        text = "\n".join(r.lid_window for r in sample if r.lid_lang == lang).encode("utf-8")[:DICT_BYTES]
        out[lang] = (text, -math.log2(shares[lang] / total))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps = compressors(out)
        for batch in batches:
            found = [identify(t, comps) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[3] for f in found], pa.float64())],
                                  names=["lang", "pred", "margin"])

    found = rows.where(check).select("lid_lang", "lid_text").mapInArrow(measure, "lang string, pred string, margin double") \
        .where("lang = pred").collect() if any(held for _, held in cuts) else []
    return out, least_margins({lang: sorted(r.margin for r in found if r.lang == lang) for lang in out})


def least_margins(found: dict[str, list[float]]) -> dict[str, float]:
    """Per language, from the sorted margins of its rightly named texts; with few, from those of all languages."""
    every = sorted(m for own in found.values() for m in own)
    out = {}
    for lang, own in found.items():
        own = own if len(own) >= HELD_ENOUGH else every
        out[lang] = max(LEAST_MARGIN, MARGIN_PART * own[int(MARGIN_QUANTILE * len(own))] if own else 0.0)
    return out


def compressors(model: dict[str, tuple[bytes, float]]) -> list[tuple[str, float, object, object]]:
    import zstandard as z
    quick = z.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=4,
                                        strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False)
    fine = z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=3, target_length=32,
                                       strategy=z.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False)
    out = []
    for lang, (text, bits) in model.items():
        pair = []
        for params in (quick, fine):
            if text:
                d = z.ZstdCompressionDict(text, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(z.ZstdCompressor(dict_data=d, compression_params=params))
            else:
                pair.append(z.ZstdCompressor(compression_params=params))
        out.append((lang, bits, *pair))
    return out


def code_lengths(text: bytes, comps: list, which: int) -> list[float]:
    chunks = [text[k:k + CHUNK] for k in range(0, len(text), CHUNK)]
    return [c[1] + 8 * sum(map(len, map(c[which].compress, chunks))) for c in comps]


def margin(text: bytes, comps: list, winner: int) -> float:
    """Lead of ``winner`` over the next language, less the bits by which pieces are shorter under another
    language, as a part of its code length: about zero or less for a text of two languages."""
    pieces = [text[k:k + PIECE] for k in range(0, len(text), PIECE)]
    bits = [[8 * len(c[3].compress(piece)) for piece in pieces] for c in comps]
    total = [c[1] + sum(b) for c, b in zip(comps, bits)]
    lead = min((t for k, t in enumerate(total) if k != winner), default=float("inf")) - total[winner]
    against = sum(own - least for own, least in zip(bits[winner], map(min, zip(*bits))))
    return (lead - against) / total[winner]


def identify(text: str, comps: list) -> tuple[str, float, float, float]:
    """(language, score, lead in bits, margin); ``und`` for a text without a letter or without a model."""
    if not comps or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, 0.0
    raw = text.lower().encode("utf-8", "replace")
    bits = code_lengths(raw, comps, 2)
    best, *rest = sorted(bits)
    if rest and rest[0] - best < RECHECK * best:
        bits = code_lengths(raw, comps, 3)
        best, *rest = sorted(bits)
    lead = rest[0] - best if rest else float("inf")
    score = 1.0 / sum(2.0 ** (-SCORE_SCALE * (b - best)) for b in bits)
    winner = bits.index(best)
    return comps[winner][0], score, lead, margin(raw, comps, winner)


def language_id(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                min_margin_bits: float = MIN_MARGIN_BITS) -> DataFrame:
    """The input's columns plus ``lang_pred``, ``lang_score`` (0 to 1), ``lang_lead`` (bits) and ``lang_rejected``.

    Only ``text_col`` enters a prediction.  A null text, or one without a letter, is ``und`` with score
    0 and rejected; so is every text if there is nothing to learn from.  A lead under
    ``min_margin_bits`` (a tie), or a margin under the language's least (0.4 of what 95 in a hundred
    rightly named held-out training rows reach), is a rejection but still names the better language: so
    texts in several or in unlearned languages and junk go.  With one language only there is no lead to
    judge by, and every text with a letter stays.  Whole texts are measured, in chunks.  The model is at most ``DICT_BYTES`` a language.  Columns of the input that bear
    one of the new names are replaced.
    """
    docs = bounded_batches(docs).drop("lang_pred", "lang_score", "lang_lead", "lang_rejected")
    model, least = train(docs, usable, id_col=id_col, text_col=text_col, lang_col=lang_col)
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comps = compressors(model)
        for batch in batches:
            found = [identify(t or "", comps) for t in batch.column(at).to_pylist()]
            langs, scores, leads, margins = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(leads, pa.float64()),
                 pa.array([g == UNDETERMINED or d < min_margin_bits or m < least[g] for g, d, m in zip(langs, leads, margins)], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_lead", "lang_rejected"])
        trim()

    return docs.mapInArrow(predict, with_fields(docs.schema, lang_pred="string", lang_score="double", lang_lead="double",
                                                lang_rejected="boolean"))


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows whose ``crc32(id as text) mod 4`` is not 2."""
    return id_bucket(F.col(id_col), 4) != 2

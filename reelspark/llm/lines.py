"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words.  Equal lines are one candidate, placed where the line first occurs.
The words of a candidate are put in one global order, rarest first; two sets at Jaccard similarity
``t`` or more share a word among the first ``n - ceil(t n) + 1`` of the longer set and the first
``n - ceil(2t/(1+t) n) + 1`` of the shorter, so only those words are joined on.  Joined pairs must pass
the length filter, the positional filter, and a parity filter (each set folds its words into 64 or
128 parity bits, and two sets differ in at least as many words as in bits); what is left is verified
by the exact similarity of the lines' sets of 64-bit word hashes.  Both joins are semi-joins that stop at
the first partner: a line needs one earlier match to go, so no pairs are made.  A line goes if an earlier line matches it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, release, stored

#: Words are counted in hashed slots of so many bits (a word's rarity is that of its slot), on 16 levels.
SLOT_BITS = 16
#: Sets up to this size fold their parity into 64 bits; larger ones keep 128.
SMALL = 64
#: Rows of the verification's id list up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: A line's number within its id, and a place as one decimal: the id times ``PLACES`` plus that number.  The number's lower 31 bits
#: count the lines of a text; above them stands a hash of the text where an id has several texts, else nothing.
LINES, PLACES = 31, 1 << 61
EPS = 1e-9


def has_words(line: Column) -> Column:
    """Whether a line has a word.  Strings compare by bytes, so one from ``!`` on starts with a word; only others take the regular expression."""
    return (line >= "!") | line.rlike("[^ \\t\\n\\x0b\\x0c\\r]")


def words_of(line: Column) -> Column:
    """The words of a line, and empty ones beside white space.  A split at spaces alone takes no regular expression, and most lines have no other white space."""
    return F.when(line.rlike("[\\t\\x0b\\x0c\\r]"), F.split(line, "[ \\t\\x0b\\x0c\\r]+")).otherwise(F.split(line, " "))


def hashes_of(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_remove(F.array_distinct(F.transform(words_of(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity_levels(docs: DataFrame, text_col: str) -> Column:
    """A constant array with a level for each slot: the more often the slot's words occur, the higher."""
    # splitting at spaces alone is the quick way; a word beside other white space counts with its neighbour,
    # which can only make the order less apt, never the join less exact
    word = F.explode(F.split(F.col(text_col), " ")).alias("word")
    slot = F.shiftrightunsigned(F.xxhash64("word"), 64 - SLOT_BITS).cast("int").alias("slot")
    found = docs.select(word).groupBy(slot).count().toArrow()        # at most 2 ** SLOT_BITS rows, which as Arrow are a megabyte on the driver
    counts = found.column("count").to_numpy()
    level = np.zeros(1 << SLOT_BITS, np.int64)
    if len(counts):
        middle = np.sort(counts)[len(counts) // 2]
        level[found.column("slot").to_numpy()] = np.clip(np.rint(2 * np.log2(counts / middle)) + 4, 0, 15)
    return F.split(F.lit(",".join(map(str, level.tolist()))), ",").cast("array<bigint>")


def ordered_keys(line: Column, levels: Column) -> Column:
    """The distinct words of a line as longs in the global order: level in the top bits, then 59 bits of the word's hash."""
    # each word is hashed once, and only distinct ones are looked up (two words with one key would both stay and do no harm)
    def key(h: Column) -> Column:
        level = F.get(levels, F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int"))
        # a slot always has a level; the stand-in tells Spark that no key is null, and it then sorts longs, not objects
        return F.coalesce(F.shiftleft(level, 59).bitwiseOR(h.bitwiseAND(F.lit((1 << 59) - 1))), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(hashes_of(line), key))


def text_mark(text: Column) -> Column:
    """30 bits of a text's hash, never 0."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 30) - 1)).bitwiseOR(F.lit(1))


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``doc, copy, text`` with a hash of the text where the id has several rows, else 0: what tells an id's texts apart; and whether an id has several.

    Ids are counted first; those that repeat are few as a rule, and are joined by broadcast if they are.
    """
    again = stored(rows.groupBy("doc").count().where("count > 1").select(F.col("doc").alias("again")), "line-again")
    several = again.count()
    mark = F.broadcast(again) if several <= BROADCAST_ROWS else again
    copy = F.when(F.col("again").isNotNull(), text_mark(F.col("text"))).otherwise(F.lit(0).cast("bigint"))
    return rows.join(mark, F.col("doc") == F.col("again"), "left").select("doc", copy.alias("copy"), "text"), several > 0


def in_lines(rows: DataFrame) -> DataFrame:
    """``doc, pos, line``: the lines of :func:`numbered` texts, each with its number within the id."""
    at = F.posexplode(F.split("text", "\n")).alias("at", "line")
    return rows.select("doc", "copy", at).select("doc", (F.shiftleft("copy", LINES) + F.col("at")).alias("pos"), "line")


def parity(keys: Column) -> Column:
    """64 parity bits of a set: each word flips the bit that its hash names."""
    return F.coalesce(F.aggregate(
        keys, F.lit(0).cast("bigint"),
        lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(F.lit(63)).cast("int")))),
        F.lit(0).cast("bigint"))


def line_matches(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc long, pos long, gone boolean``: first place of every distinct line (see ``LINES``), and whether an earlier line matches it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")) \
        .where("doc IS NOT NULL AND text IS NOT NULL")
    levels = rarity_levels(rows, "text")
    rows, repeated = numbered(rows)
    places = F.lit(PLACES).cast("decimal(20,0)")
    place = F.min((F.col("doc").cast("decimal(38,0)") * places + F.col("pos")).cast("decimal(38,0)")).alias("place")
    pos_of = F.pmod("place", places.cast("decimal(38,0)"))
    doc_of = ((F.col("place") - pos_of) / places).cast("long").alias("doc")
    first = in_lines(rows).where(has_words(F.col("line"))).groupBy("line").agg(place) \
        .select(doc_of, pos_of.cast("long").alias("pos"), "line")

    # a pair shares at least ``part`` of the sum of its sizes; if this word is the first that it shares, all those stand from here on in both sets
    part = threshold / (1 + threshold)
    most = F.floor((F.col("n") - F.col("at") + EPS) / part) - F.col("n")
    probe = F.col("n") - F.ceil(threshold * F.col("n") - EPS) + 1
    sets = first.select("doc", "pos", ordered_keys(F.col("line"), levels).alias("keys")) \
        .select("doc", "pos", "keys", F.size("keys").alias("n"), parity(F.col("keys")).alias("all"),
                F.when(F.size("keys") > SMALL, parity(F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0)))
                 .otherwise(F.lit(0).cast("bigint")).alias("more")) \
        .select("doc", "pos", "n", F.col("all").bitwiseXOR(F.col("more")).alias("bits"), "more",
                F.slice("keys", F.lit(1), probe.cast("int")).alias("prefix")) \
        .select("doc", "pos", "n", "bits", "more", F.posexplode_outer("prefix").alias("at", "key")) \
        .select(F.coalesce("key", F.lit(-1).cast("bigint")).alias("key"),
                F.coalesce(F.shiftleft(F.col("n").cast("bigint"), 32) + F.shiftleft(most, 1) + (F.col("at") == 0).cast("bigint"),
                           F.lit(0).cast("bigint")).alias("shape"), "bits", "more", "doc", "pos")
    # ``shape`` is the set's size, the largest size of a partner that it allows and whether the word is the set's first: one column to shuffle;
    # columns are in the order in which the join below names them: its two sides are then the same to Spark, and are shuffled once
    # (no line here is without words; the outer form and the stand-ins keep Catalyst from inferring filters
    # that would compute the sets a second time below the aggregate, or tell the join's two sides apart)

    # Entries with a partner that passes the filters: only that there is one is asked, so a large family of
    # similar lines makes no pairs.  Both sides are one and the same exchange; the condition names both
    # sides throughout, so that nothing of it is pushed below the exchange.  That each size is at most what the other's entry allows is
    # the positional filter, and the length and prefix filters follow from it; two whole numbers are compared a pair.  Two large
    # sets compare 128 parity bits, and a small set has its halves folded, so the other's are folded too.  The first entry
    # of every line comes along, partner or not: it is the line's place.
    (na, most_a), (nb, most_b) = [(f"shiftright({x}.shape, 32)", f"shiftright({x}.shape & 4294967295, 1)") for x in "ab"]
    need = f"{part!r}D * ({na} + {nb}) - {EPS}D"
    near = f"""{nb} <= {most_a} AND {na} <= {most_b}
            AND CASE WHEN {na} > {SMALL} AND {nb} > {SMALL} THEN bit_count(a.bits ^ b.bits) + bit_count(a.more ^ b.more)
                     ELSE bit_count((a.bits ^ b.bits) ^ (a.more ^ b.more)) END <= {na} + {nb} - 2 * ceil({need})"""
    found = docs.sparkSession.sql(f"""
        SELECT key, shape, bits, more, doc, pos, a.shape & 1 = 1 AS first, EXISTS (
          SELECT 1 FROM {{b}} b WHERE a.key = b.key AND {near} AND (a.doc <> b.doc OR a.pos <> b.pos)) AS mate
        FROM {{a}} a""", a=sets, b=sets)
    # a row's choice is an array, not a filter: a filter would be pushed below the join, and the join made twice
    entry = [F.when(F.col("mate"), F.col(c)).alias(c) for c in ("key", "shape", "bits", "more")]
    chosen = F.when(F.col("first") | F.col("mate"), F.array(F.struct(*entry, "doc", "pos", "first")))
    found = stored(found.select(F.explode_outer(chosen).alias("x")).where("x IS NOT NULL").select("x.*"), "line-active")
    active = found.where("key IS NOT NULL").drop("first")

    # verification reads the lines concerned from the input again; their places are few
    ids = stored(active.select("doc", "pos").distinct(), "line-ids")
    few = ids.count() <= BROADCAST_ROWS
    release(docs.sparkSession)
    some = rows.join(F.broadcast(ids.select("doc").distinct()) if few else ids.select("doc").distinct(), "doc", "left_semi")
    some = in_lines(some).join(F.broadcast(ids) if few else ids, ["doc", "pos"])
    words = some.select("doc", "pos", hashes_of(F.col("line")).alias("words"))
    words = stored(words.dropDuplicates(["doc", "pos"]) if repeated else words, "line-words")      # a place occurs twice only by equal rows
    full = active.join(words, ["doc", "pos"]).select("key", "shape", "bits", "more", "doc", "pos", "words")

    # the filters again, now for the pair itself: few pairs are left whose words are compared
    late = full.alias("a").join(
        full.alias("b"),
        (F.col("a.key") == F.col("b.key")) & F.expr(f"""{near} AND (b.doc < a.doc OR b.doc = a.doc AND b.pos < a.pos)
            AND size(array_intersect(a.words, b.words)) >= {need}"""), "left_semi") \
        .select("doc", "pos", F.lit(True).alias("gone"))
    # every late place is a line's first place, so grouping adds none
    return found.where("first").select("doc", "pos", F.lit(False).alias("gone")).unionByName(late) \
        .groupBy("doc", "pos").agg(F.max("gone").alias("gone"))


def kept_lines(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """A row per document: ``doc, own`` (its text's mark), ``size`` (its lines) and ``keep`` (numbers of those that stay)."""
    places = line_matches(docs, threshold=threshold, id_col=id_col, text_col=text_col).where("NOT gone")
    kept = places.groupBy(F.col("doc").alias("kept_doc"), F.shiftright("pos", LINES).alias("kept_copy")) \
        .agg(F.collect_list(F.col("pos").bitwiseAND(F.lit((1 << LINES) - 1)).cast("int")).alias("kept_pos"))
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    none = F.array().cast("array<int>")
    blank = F.filter(F.transform(lines, lambda x, k: F.when(~has_words(x), k)), lambda k: k.isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_mark(text).alias("own"), F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).alias("size"),
                       F.coalesce(blank, none).alias("blank"), text.isNotNull().alias("there"))
    every = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1)).otherwise(none)
    found = F.when(F.col("there"), F.coalesce("kept_pos", none)).otherwise(none)
    keep = F.when(F.col("doc").isNull(), every).otherwise(F.array_sort(F.array_union("blank", found)))
    # an id with one text has copy 0, an id with several those texts' marks
    same = (F.col("doc") == F.col("kept_doc")) & ((F.col("kept_copy") == 0) | (F.col("kept_copy") == F.col("own")))
    return rows.join(kept, same, "left").select("doc", "own", "size", keep.alias("keep"))


def duplicate_lines(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_lines``, ``n_removed``, ``kept_lines`` (numbers from 0, ascending).

    Lines end at ``\\n``.  A line goes if a line that comes before it (by id, then line number, over the
    whole table) has a word set at Jaccard similarity ``threshold`` or more - judged on the input, not on
    what is left.  Lines without a word are always kept.  A null text has no lines; a row with a null id
    keeps all its lines and matches nothing.  Rows that share an id and a text are one and are treated alike;
    several texts of one id are told apart and come in the order of a hash of the text.  An empty table gives an empty one.
    """
    return kept_lines(docs, threshold, id_col, text_col).select(
        F.col("doc").alias(id_col), F.col("size").cast("long").alias("n_lines"),
        (F.col("size") - F.size("keep")).cast("long").alias("n_removed"), F.col("keep").alias("kept_lines"))


def drop_duplicate_lines(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with the duplicate lines taken out of ``text_col`` (see :func:`duplicate_lines`); rows that keep no line
    although they had one with words are dropped, and of rows with one id and one text one stays."""
    found = kept_lines(docs, threshold, id_col, text_col).where("size > size(keep)").select("doc", "own", "keep").dropDuplicates(["doc", "own"])
    # the input's columns travel in one struct, so that no name of theirs can clash
    rows = once(docs, id_col, text_col).select(F.struct(*docs.columns).alias("row"))
    text = F.col(f"row.{text_col}")
    rows = rows.join(found, (F.col(f"row.{id_col}").cast("long") == F.col("doc")) & (text_mark(text.cast("string")) == F.col("own")), "left")
    lines = F.split(text, "\n")
    rest = F.when(F.col("doc").isNull(), text).otherwise(F.array_join(F.transform("keep", lambda k: F.get(lines, k)), "\n"))
    return rows.select("row", "doc", rest.alias("rest")).where(F.col("doc").isNull() | has_words(F.col("rest"))) \
        .select(*[F.col("rest").alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])


#: Every pair of lines that share a word and whose sizes allow the threshold is compared in full.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, list_distinct(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '),
                                                          lambda x: x <> '')) AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
s AS (SELECT doc_id, pos, len(ws) AS n, list_sort(ws) AS ws FROM l),
c AS (SELECT ws, n, min(struct_pack(d := doc_id, p := pos)) AS place FROM s WHERE n > 0 GROUP BY ws, n),
w AS (SELECT place, n, unnest(ws) AS word FROM c),
pr AS (SELECT a.place AS late, b.place AS early, a.n AS na, b.n AS nb, count(*) AS shared
       FROM w a JOIN w b ON a.word = b.word AND b.place < a.place AND b.n BETWEEN 0.8 * a.n - 1e-9 AND a.n / 0.8 + 1e-9
       GROUP BY ALL HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
k AS (SELECT s.doc_id, s.pos FROM s LEFT JOIN c ON c.ws = s.ws
      WHERE s.n = 0 OR (struct_pack(d := s.doc_id, p := s.pos) = c.place AND c.place NOT IN (SELECT late FROM pr))),
g AS (SELECT doc_id, list(pos::INT ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
  (coalesce(len(string_split(text, chr(10))), 0) - coalesce(len(kept), 0))::BIGINT AS n_removed, coalesce(kept, []::INT[]) AS kept_lines
FROM documents LEFT JOIN g USING (doc_id)"""

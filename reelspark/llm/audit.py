"""Filter interaction audit by wide packed counters.

Which filters a document fails is a mask of a few bits.  What every step of every order of the filters does
with a document depends on its mask alone, so each mask has one big integer whose 64-bit fields hold the
outcome of all steps of all orders at once (600 of them for five filters, in each of six sections).  Adding
up documents is adding up these integers: a field never exceeds the number of documents, so none runs over
into its neighbour, and one sum a part holds the whole report, which is unpacked at the end.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a field.  Counts are longs, so a field cannot overflow before the count itself does.
FIELD = 64
SECTIONS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WHITE = " \t\n\x0b\x0c\r"
#: The least id of a group of equal texts and how often it occurs there travel in one decimal.
TIMES = 1 << 40


def outcomes(filters: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders, and per section a 0/1 array (mask, order x step) of what that step does with such a document."""
    orders = ["".join(p) for p in permutations(filters)]
    masks = np.arange(1 << len(filters))
    out = {k: np.zeros((len(masks), len(orders) * len(filters)), np.uint64) for k in SECTIONS[:4]}
    for i, order in enumerate(orders):
        earlier = np.zeros(len(masks), bool)
        for j, letter in enumerate(order):
            bit = 1 << filters.index(letter)
            fails, at = (masks & bit) > 0, i * len(filters) + j
            out["kept"][:, at] = ~(earlier | fails)
            out["removed"][:, at] = fails & ~earlier
            out["redundant"][:, at] = fails & earlier
            out["unique_fails"][:, at] = masks == bit
            earlier |= fails
    return orders, out


def packed(filters: str) -> tuple[list[str], list[list[int]]]:
    """All orders, and the big integer of ``[mask][good + 2 * toxic]``: six sections of a field a step."""
    orders, out = outcomes(filters)
    nothing = np.zeros_like(out["removed"][0])
    table = []
    for mask in range(1 << len(filters)):
        row = []
        for labels in range(4):
            lost = out["removed"][mask]
            fields = np.concatenate([out[k][mask] for k in SECTIONS[:4]] + [lost if labels & 1 else nothing, lost if labels & 2 else nothing])
            row.append(int.from_bytes(fields.astype("<u8").tobytes(), "little"))
        table.append(row)
    return orders, table


def unpacked(total: int, steps: int) -> np.ndarray:
    """The counts (section, step) of a sum of packed integers."""
    size = len(SECTIONS) * steps
    return np.frombuffer(total.to_bytes(size * FIELD // 8, "little"), "<u8").reshape(len(SECTIONS), steps).astype(np.int64)


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, " \
         "good_lost long, toxic_lost long, shapley long"


def interaction_report(counts: DataFrame, filters: str) -> DataFrame:
    """The report from ``part string, mask int, good boolean, toxic boolean, n long`` (bit k of the mask: fails ``filters[k]``).

    Rows of one kind may occur many times.  They are added up before the shuffle, so a part meets in one
    group as at most four rows a mask, however many documents it has.
    """
    steps = len(list(permutations(filters))) * len(filters)
    kinds = counts.groupBy("part", "mask", (F.col("good").cast("int") + 2 * F.col("toxic").cast("int")).alias("labels")) \
                  .agg(F.sum("n").alias("n"))

    def report(group: pa.Table) -> pa.Table:
        orders, table = packed(filters)
        total = sum(n * table[mask][labels] for mask, labels, n in zip(*(group.column(c).to_pylist() for c in ("mask", "labels", "n"))))
        found = unpacked(total, steps)
        letters = [x for order in orders for x in order]
        removed = found[SECTIONS.index("removed")]
        shares = {x: int(removed[[y == x for y in letters]].sum()) for x in filters}
        return pa.table([pa.array([group.column("part")[0].as_py()] * steps, pa.string()),
                         pa.array([order for order in orders for _ in filters], pa.string()),
                         pa.array(list(range(1, len(filters) + 1)) * len(orders), pa.int32()),
                         *[pa.array(x, pa.int64()) for x in found], pa.array([shares[x] for x in letters], pa.int64())],
                        names=[c.split()[0] for c in REPORT.split(", ")])
    return kinds.groupBy("part").applyInArrow(report, REPORT)


def failure_mask(text: Column) -> Column:
    """Bits 0 to 3: under 100 words; under 80 % of words distinct; over 10 % capitals; holds one of ``#$%&*|``."""
    inner = F.btrim(text, F.lit(WHITE))
    words, none = F.split(inner, "[ \t-\r]+"), (inner == "").cast("int")      # an empty text splits into one empty word
    n, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
             text.rlike("[#$%&*|]")]
    return reduce(Column.__add__, [f.cast("int") * (1 << k) for k, f in enumerate(fails)])


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                   good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, mask, good, toxic, n`` of all documents under the five filters (bit 4: equal to the text of a smaller id).

    Equal texts are grouped by sha256.  Copies are counted before any group meets, by (text, part, labels), with
    the least id of each and its occurrences; the group then only compares these least ids.  So a text that a third of all rows
    share is a few rows in the shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("content"), failure_mask(text).alias("mask"))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("label_id")) \
        .agg(F.max((F.col(good_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, F.col("id") == F.col("label_id"), "left") \
        .select("id", "part", "content", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    same = rows.groupBy("id", "content", "part", "good", "toxic").agg(F.max("mask").alias("mask"), F.count("*").alias("n"))
    wide = "decimal(38,0)"
    least = (F.col("id").cast(wide) * F.lit(TIMES).cast("decimal(14,0)") + F.col("n")).cast(wide)
    kinds = same.groupBy("content", "part", "good", "toxic").agg(
        F.max("mask").alias("mask"), F.sum("n").alias("n"), F.min(least).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.floor(F.col("least") / F.lit(TIMES).cast("decimal(14,0)"))
    kinds = kinds.withColumn("first_id", first)
    stays = F.col("no_id") + F.when(F.col("first_id") == F.min("first_id").over(Window.partitionBy("content")),
                                    F.pmod("least", F.lit(TIMES).cast(wide)).cast("long")).otherwise(0)
    both = kinds.withColumn("stays", stays).select(
        "part", (F.col("good") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"),
        F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")),
                          F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))).alias("x"))
    return both.select("part", F.col("x.mask").alias("mask"), "good", "toxic", F.col("x.n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each step of each order of five filters keeps and removes, per part: see ``REPORT`` for the columns.

    Filters: A under 100 words; B fewer than 80 % of the words distinct; C over 10 % of code points in A-Z;
    D one of ``#$%&*|``; E equal to the text of a smaller id.  One row per part, order and step, zeros included.
    ``kept``: left after the step; ``removed``: by it; ``redundant``: fails its filter but went before;
    ``unique_fails``: fails its filter and no other; ``good_lost``, ``toxic_lost``: removed documents with that label;
    ``shapley``: removed by the step's filter, over all orders.  Column names can be given as for :func:`failure_counts`.

    A null text is empty; a null part is the empty string.  Rows with a null id have no label and neither are nor make copies;
    of repeated rows with the least id of a text none is a copy.  Labels may hold an id several times: any 1 counts.
    No other column of the input is looked at.  An empty table gives no part, hence no row.
    """
    return interaction_report(failure_counts(docs, labels, **columns), "ABCDE")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE position(g.x IN filter_order) < step), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step), f WHERE f.x = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""

"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate so that its expected text mass is its share of the total; each
document draws its number of copies by inverting the Poisson distribution with that rate at a
uniform value hashed from its id, and the copies are put in a global hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A rate is split into equal parts of at most this much, drawn separately and added (a sum of Poisson
#: variables is Poisson), so that ``exp(-rate)`` never underflows and the tables below stay short.
PART_RATE = 8.0
#: Terms of the distribution table; the tail beyond them is under 1e-20 at ``PART_RATE``.
TERMS = 48
#: Rows of the per-source table up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000


def uniform(*parts: Column) -> Column:
    """A uniform value in [0, 1) from the md5 of the parts joined by ':' (52 bits; a null part is 'null')."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a Poisson variable of mean ``rate``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k.cast("double")).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k.cast("double"))).alias("c")),
        lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: dict | None, *, source_col: str, text_col: str,
                 default_weight: float, total_mass: float | None) -> DataFrame:
    """One row per source: mass (characters plus one per document), repetition rate and its table.

    ``total_mass`` is the expected mass of the mixture (None: that of the input).
    """
    mass = F.sum(F.coalesce(F.length(text_col), F.lit(0)) + F.lit(1)).cast("bigint")
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    per = stored(docs.groupBy(F.col(source_col).alias("mix_source")).agg(mass.alias("mix_mass"))
                 .withColumn("mix_weight", weight), "mix-sources")
    n, all_mass, all_weight = per.agg(F.count(F.lit(1)), F.sum("mix_mass"), F.sum("mix_weight")).first()
    target = float(all_mass or 0) if total_mass is None else float(total_mass)
    rate = F.lit(target) * F.col("mix_weight") / F.lit(float(all_weight or 1.0)) / F.col("mix_mass")
    rates = (per.withColumn("mix_rate", rate)
             .withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_RATE)).cast("int"))
             .withColumn("mix_table", poisson_table(F.col("mix_rate") / F.col("mix_parts"))))
    return F.broadcast(rates) if n <= BROADCAST_ROWS else rates


def poisson_mix(docs: DataFrame, weights: dict | None = None, *, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", default_weight: float = 1.0, total_mass: float | None = None,
                seed: str = "mix") -> DataFrame:
    """Replicate documents so that sources meet target weights, in a global hash order.

    Returns the input's columns plus ``mix_copy`` (int from 0), ``mix_copies`` (int), ``mix_rate``
    (double) and ``mix_key`` (long), globally ordered by ``mix_key``.  A source missing from
    ``weights`` has ``default_weight``; a null source is a source of its own; null and empty texts
    have the mass of their end mark, one.  Rows with equal ids (or null ids) draw the same count.
    Columns of the input that bear one of the new names are replaced.  An empty table gives an empty one.

    The only shuffle of texts is that of the final order: the table of sources is broadcast when it
    has at most ``BROADCAST_ROWS`` rows (else joined by a shuffle with AQE's skew split).
    """
    new = ["mix_source", "mix_mass", "mix_weight", "mix_parts", "mix_table", "mix_rate", "mix_copies", "mix_copy",
           "mix_key"]
    docs = docs.drop(*new)
    rates = source_rates(docs, weights, source_col=source_col, text_col=text_col, default_weight=default_weight,
                         total_mass=total_mass)
    keep = docs.columns
    draws = F.transform(F.sequence(F.lit(0), F.col("mix_parts") - 1),
                        lambda i: F.size(F.filter("mix_table", lambda c: c <= uniform(F.lit(seed), F.col(id_col), i))))
    out = (docs.join(rates, F.col(source_col).eqNullSafe(F.col("mix_source")))
           .withColumn("mix_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
           .where("mix_copies > 0")
           .select(*keep, "mix_rate", "mix_copies", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_copy")))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-order"),
                                               F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                                               F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return out.withColumn("mix_key", key).orderBy("mix_key")


def oracle(source: str = "documents", default_weight: float = 1.0, seed: str = "mix") -> str:
    """DuckDB SQL for :func:`poisson_mix` with equal weights and the input's own mass over ``source``."""
    return f"""
WITH RECURSIVE per AS (
  SELECT source AS s, sum(coalesce(length(text), 0) + 1)::BIGINT AS mass, {default_weight}::DOUBLE AS w
  FROM {source} GROUP BY source),
tot AS (SELECT sum(mass)::DOUBLE AS m, sum(w) AS w FROM per),
rates AS (SELECT s, tot.m * per.w / tot.w / mass AS rate FROM per, tot),
parts AS (SELECT s, rate, greatest(1, ceil(rate / {PART_RATE}))::INT AS n FROM rates),
tab AS (
  SELECT s, rate, n, rate / n AS r, 0 AS k, exp(-(rate / n)) AS p, exp(-(rate / n)) AS c FROM parts
  UNION ALL
  SELECT s, rate, n, r, k + 1, p * r / (k + 1)::DOUBLE, c + p * r / (k + 1)::DOUBLE FROM tab WHERE k < {TERMS}),
u AS (
  SELECT d.rowid_ AS rid, p.s, p.n, i.i,
    ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i.i), 1, 13))::BIGINT
      / {float(1 << 52)} AS u
  FROM (SELECT row_number() OVER () AS rowid_, * FROM {source}) d
  JOIN parts p ON d.source IS NOT DISTINCT FROM p.s, unnest(range(p.n)) i(i)),
cnt AS (
  SELECT rid, count(t.k) AS copies FROM u JOIN tab t ON t.s IS NOT DISTINCT FROM u.s AND t.c <= u.u GROUP BY rid),
copies AS (
  SELECT d.*, p.rate, c.copies, j.j
  FROM (SELECT row_number() OVER () AS rowid_, * FROM {source}) d
  JOIN cnt c ON c.rid = d.rowid_ JOIN parts p ON d.source IS NOT DISTINCT FROM p.s, unnest(range(c.copies)) j(j))
"""

"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node and a join back on the node, so a node with very many edges is
aggregated before the shuffle and its join side can be split; nothing is gathered per component.
A table of few edges is read as one partition, so that its steps need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges up to which a step runs as one task; more are shuffled.
FEW_EDGES = 20_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(sym: DataFrame) -> DataFrame:
    """Every (u, v) with the least node of u and its neighbours."""
    least = sym.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    return sym.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """``node long, component long`` for every node but the least of its component, which names it.

    Edges are undirected; loops and repeats do no harm, edges with a null end are ignored.  Nodes
    without an edge to another node are not listed.
    """
    cur = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"),
                       (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")) \
        .where("ok AND a > b").select("a", "b").distinct()
    cur = stored(cur, name)
    state = _state(cur)
    while state[0]:
        edge = cur.coalesce(1) if state[0] <= FEW_EDGES else cur
        sym = edge.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        large = _star(sym).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a row's two edges are an array, so that the join is made once
        pair = F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))
        cur = stored(_star(large).select(F.inline(pair)).where("a > b").distinct(), name)
        last, state = state, _state(cur)
        if last == state:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))

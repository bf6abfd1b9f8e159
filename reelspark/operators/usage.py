"""Roll-ups: quota use, download counters, request-log statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


# A2 ----------------------------------------------------------------------
def quota_usage(users: DataFrame, items: DataFrame, parts: DataFrame, *, user_key: str,
                item_key: str, item_user_key: str, part_item_key: str, part_bytes: str,
                total_bytes: int = 1073741824, item_limit: int = 100) -> DataFrame:
    """Bytes and item count per user against the quota limits.

    ``parts`` (many rows per item) is reduced to one row per item *before*
    it meets ``items``: the partial aggregate runs map-side, so the join
    shuffles one row per item instead of every part.
    """
    per_item = parts.groupBy(F.col(part_item_key).alias("__ik")).agg(F.sum(part_bytes).alias("__b"))
    it = items.select(F.col(item_key).alias("__ik"), F.col(item_user_key).alias("__uk"))
    per_user = (it.join(per_item, "__ik", "left")
                .groupBy("__uk")
                .agg(F.sum(F.coalesce(F.col("__b"), F.lit(0))).alias("__used"),
                     F.count(F.lit(1)).alias("__n")))
    u = users.select(F.col(user_key).alias("user_id"))
    j = u.join(per_user, u["user_id"] == per_user["__uk"], "left")
    used = F.coalesce(F.col("__used"), F.lit(0)).cast("bigint")
    n = F.coalesce(F.col("__n"), F.lit(0)).cast("bigint")
    return j.select(
        "user_id",
        used.alias("used_bytes"),
        n.alias("gif_count"),
        F.lit(total_bytes).alias("total_bytes"),
        F.lit(item_limit).alias("gif_limit"),
        (F.lit(total_bytes) - used).alias("remaining"),
        ((used > F.lit(total_bytes)) | (n > F.lit(item_limit))).alias("over_limit"),
    )


# A4 ----------------------------------------------------------------------
def download_counts(items: DataFrame, events: DataFrame, *, item_key: str, event_key: Column,
                    is_download: Column) -> DataFrame:
    """Download counter per item; items without downloads keep 0.

    Events are counted per key first (map-side partial aggregate), then
    joined to the items, so the join sees one row per key.
    """
    counts = (events.filter(is_download)
              .groupBy(event_key.alias("__k"))
              .agg(F.count(F.lit(1)).alias("__n")))
    j = items.join(counts, items[item_key] == counts["__k"], "left")
    return j.withColumn("downloads", F.coalesce(F.col("__n"), F.lit(0)).cast("bigint")).drop("__k", "__n")


# A5 ----------------------------------------------------------------------
#: Groups up to which the per-group table is broadcast; beyond it the joins shuffle.
BROADCAST_GROUPS = 10_000


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                      probs: dict[str, float], n_cuts: int = 256) -> DataFrame:
    """Row count, maximum and exact ``quantile_cont`` (linear interpolation) per group.

    Returns the group columns, ``n`` (all rows), ``max_value`` and one column per probability; null
    values do not count for the percentiles, a group of nulls alone has null percentiles, and null
    groups are groups.

    1. one scan: per group the counts, the maximum and ``n_cuts`` sketched cut points (partial and
       bounded, shuffled one row a group and task);
    2. one scan: rows per (group, cut bucket), counted map-side, with the bucket's least and
       greatest value; the running count names the bucket that holds each wanted rank;
    3. one scan: only the rows of those buckets (about 1 in ``n_cuts``), as a (value, count)
       histogram counted map-side, are ranked.  A bucket of one value needs no ranking.
    No pass shuffles all rows, and the sketch only chooses buckets: every rank is counted exactly.
    """
    g = list(group_cols)
    v = F.col(value_col)
    rows = df.select(*g, v.alias("__v"))
    fracs = [i / n_cuts for i in range(1, n_cuts)]
    stats = reliable_checkpoint(rows.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.count("__v").alias("__n"), F.max("__v").alias("max_value"),
        F.percentile_approx("__v", fracs, 10 * n_cuts).alias("__cuts")))
    small = stats.count() <= BROADCAST_GROUPS

    def same(left: DataFrame, right: DataFrame, cols: Sequence[str]):
        cond = F.lit(True)
        for c in cols:
            cond = cond & left[c].eqNullSafe(right["__r_" + c])
        return cond

    def renamed(d: DataFrame, cols: Sequence[str]) -> DataFrame:
        return d.withColumnsRenamed({c: "__r_" + c for c in cols})

    cuts = renamed(stats.select(*g, "__cuts"), g)
    valued = rows.where("__v IS NOT NULL")
    placed = valued.join(F.broadcast(cuts) if small else cuts, same(valued, cuts, g)) \
        .select(*g, "__v", F.size(F.filter("__cuts", lambda x: x <= F.col("__v"))).alias("__b"))
    buckets = placed.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__bn"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    run = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("__end", F.sum("__bn").over(run)).withColumn("__n", F.sum("__bn").over(Window.partitionBy(*g)))
    ranks = []
    for p in probs.values():
        at = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        ranks += [F.floor(at), F.ceil(at)]
    wanted = F.array_distinct(F.array(*ranks))
    buckets = reliable_checkpoint(buckets.withColumn(
        "__ranks", F.filter(wanted, lambda r: (r >= F.col("__end") - F.col("__bn")) & (r < F.col("__end")))).where(F.size("__ranks") > 0))
    # at most two ranks a probability and group: as few rows as there are groups, times a constant
    flat = buckets.where("__lo = __hi").select(*g, F.explode("__ranks").alias("__rank"), F.col("__lo").alias("__val"))
    keep = renamed(buckets.where("__lo < __hi").select(*g, "__b", (F.col("__end") - F.col("__bn")).alias("__start"), "__ranks"), [*g, "__b"])
    inside = placed.join(F.broadcast(keep) if small else keep, same(placed, keep, [*g, "__b"])) \
        .groupBy(*g, "__b", "__start", "__ranks", "__v").agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*g, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__to", F.col("__start") + F.sum("__c").over(order))
    hits = inside.select(*g, F.explode(F.filter("__ranks", lambda r: (r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")))).alias("__rank"),
                         F.col("__v").alias("__val")).unionByName(flat)
    vals = renamed(hits.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__val"))).alias("__vals")), g)
    out = stats.join(vals, same(stats, vals, g), "left")
    sel = [*[F.col(c) for c in g], F.col("n"), F.col("max_value")]
    for name, p in probs.items():
        at = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.col("__vals")[F.floor(at)], F.col("__vals")[F.ceil(at)]
        sel.append(F.when(F.floor(at) == at, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*sel)


def request_rollup(log: DataFrame, *, group_col: str, value_col: str, digits: int = 4) -> DataFrame:
    """Request count, p50, p95 and max duration per group (null groups and all-null groups included)."""
    out = exact_percentiles(log, [group_col], value_col, {"p50": 0.5, "p95": 0.95})
    return out.select(group_col, "n", F.round("p50", digits).alias("p50"), F.round("p95", digits).alias("p95"), "max_value")

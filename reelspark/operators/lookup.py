"""Keyed reads: projections, look-ups, optional filters, listings, top-k.

All operators are lazy DataFrame functions.  Joins are left to Catalyst and
AQE: a side is broadcast only when AQE measures it under
``spark.sql.autoBroadcastJoinThreshold`` at run time, so nothing that grows
with the data is broadcast on a guess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# P1 ----------------------------------------------------------------------
def public_view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the public columns; the scan reads nothing else."""
    return df.select(*columns)


# P2 ----------------------------------------------------------------------
def batch_lookup(df: DataFrame, keys: DataFrame, df_key: str, keys_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (a left semi join, no fan-out)."""
    keys_key = keys_key or df_key
    k = keys.select(F.col(keys_key).alias("__k"))
    return df.join(k, df[df_key] == k["__k"], "left_semi")


# P3 ----------------------------------------------------------------------
def filter_optional(df: DataFrame, column: str, value: str | None, all_token: str = "all") -> DataFrame:
    """``value`` in (None, '', 'all') means no predicate.

    Expressed as ``:v = 'all' OR col = :v`` so the parameter stays a literal
    and Catalyst folds the dead branch away.
    """
    v = all_token if value in (None, "") else value
    return df.filter((F.lit(v) == F.lit(all_token)) | (F.col(column) == F.lit(v)))


# P4 / M10 ----------------------------------------------------------------
def valid_at(df: DataFrame, expire_col: str, as_of: Column, issued_col: str | None = None,
             null_means_never: bool = False) -> DataFrame:
    """Rows still valid at ``as_of``: ``expire > as_of`` (strict) and issued by then."""
    cond = F.col(expire_col) > as_of
    if null_means_never:
        cond = F.col(expire_col).isNull() | cond
    if issued_col:
        cond = cond & (F.col(issued_col) <= as_of)
    return df.filter(cond)


# P5 ----------------------------------------------------------------------
def role_gate(df: DataFrame, role_col: str, role: str = "admin") -> DataFrame:
    return df.filter(F.col(role_col) == F.lit(role))


# P6 ----------------------------------------------------------------------
def login_outcome(attempts: DataFrame, users: DataFrame, attempt_key: str, user_key: str,
                  verified_col: str, secret_ok_col: str) -> DataFrame:
    """Outcome in the service's order: unknown -> unverified -> wrong secret -> ok.

    ``secret_ok_col`` is a boolean on the attempt (hash checking is not built).
    """
    u = users.select(F.col(user_key).alias("__uk"), F.col(verified_col).alias("__verified"))
    j = attempts.join(u, attempts[attempt_key] == u["__uk"], "left")
    outcome = (F.when(F.col("__uk").isNull(), "unknown")
               .when(~F.coalesce(F.col("__verified"), F.lit(False)), "unverified")
               .when(~F.col(secret_ok_col), "wrong_secret")
               .otherwise("ok"))
    return j.withColumn("outcome", outcome).drop("__uk", "__verified")


# J14 ---------------------------------------------------------------------
def mail_eligibility(requests: DataFrame, users: DataFrame, request_key: str, user_key: str,
                     verified_col: str, kind_col: str) -> DataFrame:
    """'forgot' needs a verified user, 'resend' an unverified one."""
    u = users.select(F.col(user_key).alias("__uk"), F.col(verified_col).alias("__verified"))
    j = requests.join(u, requests[request_key] == u["__uk"], "left")
    v = F.coalesce(F.col("__verified"), F.lit(False))
    outcome = (F.when(F.col("__uk").isNull(), "unknown")
               .when((F.col(kind_col) == "forgot") & ~v, "not_verified")
               .when((F.col(kind_col) == "resend") & v, "already_verified")
               .otherwise("send"))
    return j.withColumn("outcome", outcome).drop("__uk", "__verified")


# J1 / J2 -----------------------------------------------------------------
def profile_view(profiles: DataFrame, users: DataFrame, profile_key: str, user_key: str,
                 columns: Sequence[str]) -> DataFrame:
    """profiles LEFT JOIN users with a predicate on the right side.

    The predicate makes the join effectively inner; written as inner so the
    plan shows it (Catalyst would rewrite the left form the same way).
    """
    j = profiles.join(users, profiles[profile_key] == users[user_key], "inner")
    return j.select(*columns)


# P7 ----------------------------------------------------------------------
def object_readiness(keys: DataFrame, inventory: DataFrame, key: str, inv_key: str,
                     size_col: str) -> DataFrame:
    """missing (no object) / empty (size 0) / ready."""
    inv = inventory.select(F.col(inv_key).alias("__ik"), F.col(size_col).alias("size"))
    j = keys.join(inv, keys[key] == inv["__ik"], "left")
    state = (F.when(F.col("__ik").isNull(), "missing")
             .when(F.col("size") <= 0, "empty")
             .otherwise("ready"))
    return j.withColumn("state", state).drop("__ik")


# W1 ----------------------------------------------------------------------
def top_k_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rn") -> DataFrame:
    """Newest-first top-k per key.

    ``row_number() <= k`` plans as a partial WindowGroupLimit before the
    shuffle, so each map task ships at most k rows per key: a hot key costs
    k rows of network, not its whole history.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# O1 ----------------------------------------------------------------------
def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k; plans as TakeOrderedAndProject (k rows per task)."""
    return df.orderBy(*order).limit(k)


# S6 / A1 / O2 ------------------------------------------------------------
def listing_envelope(users: DataFrame, items: DataFrame, user_key: str, item_user_key: str,
                     order_time: str, order_id: str, item_cols: Sequence[str], page_size: int = 20,
                     bucket_ms: int = 30 * 86_400_000) -> DataFrame:
    """The listing envelope ``{data, total, page, limit}`` per user, newest first.

    The service returns all of a user's items in one envelope with constant
    page 1 / limit 20.  One unbounded array per user cannot hold a hot user,
    so every page is its own row: ``data`` holds at most ``page_size`` items,
    every item appears on exactly one page, and ``total`` is the user's full
    count.  Users without items get page 1 with an empty array and total 0.

    Newest-first position = total + 1 - oldest-first position, and both come
    from a bucketed running count, so no user's items are sorted in one task.
    """
    from ..functions.timecols import epoch_ms
    from .ordered import keyed_position
    ranked = keyed_position(items, [item_user_key], order_time, order_id, "__asc", total_col="total",
                            bucket_ms=bucket_ms, t_ms=epoch_ms(F.col(order_time)), summary_from_rows=True)
    pos = F.col("total") - F.col("__asc") + 1
    ranked = ranked.withColumn("__pos", pos).withColumn("page", ((pos - 1) / F.lit(page_size)).cast("int") + 1)
    packed = (ranked.groupBy(F.col(item_user_key).alias("__uk"), "page")
              .agg(F.max("total").alias("total"),
                   F.array_sort(F.collect_list(F.struct(F.col("__pos"), *[F.col(c) for c in item_cols])))
                   .alias("__data")))
    u = users.select(F.col(user_key).alias("user_id"))
    j = u.join(packed, u["user_id"] == packed["__uk"], "left")
    return j.select(
        "user_id",
        F.coalesce(F.col("page"), F.lit(1)).alias("page"),
        F.lit(page_size).alias("limit"),
        F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.transform("__data", lambda s: s.dropFields("__pos")), F.array()).alias("data"),
    )

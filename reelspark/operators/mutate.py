"""Mutations as snapshot rewrites: snapshot + change set -> new snapshot.

Plain Parquet tables have no MERGE, so every mutation is a join between the
current snapshot and a change set, producing the next snapshot (write it to
a new version folder; never overwrite a path being read).  Change sets are
reduced to one row per key before they meet the snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# S5 / M1 / F15 -----------------------------------------------------------
def insert_defaults(rows: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Fill column defaults on insert: missing columns are added, nulls filled.

    ``defaults`` maps a column to an expression that may use other columns
    (e.g. ``expire_at = created_at + 15 min``).
    """
    out = rows
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), d) if c in rows.columns else d)
    return out


def newest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One change per key: the first by ``order`` (WindowGroupLimit, top-1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return changes.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


# M2 / T7 -----------------------------------------------------------------
def upsert(snapshot: DataFrame, changes: DataFrame, *, key: str, arrival: Column,
           update_cols: Sequence[str], keep_cols: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET update_cols.

    Changes apply in *arrival* order (not business time), so the latest
    arrival per key sets the updated columns.  ``keep_cols`` are not in the
    update list: an existing row keeps them, a new key takes them from its
    earliest change (the one that inserted it).  A null in an updated column
    overwrites.  Adds ``action``: insert / update / keep.

    Of changes with equal arrivals the one with the greatest (for kept columns the least) content
    counts, so a rerun gives the same rows.  A null key conflicts with nothing, as in the service's
    table: changes without a key are left out, snapshot rows without one are kept.
    """
    # one aggregate over the change set: newest and oldest change per key, combined map-side
    upd = F.struct(arrival.alias("__arr"), *[F.col(c).alias(f"u_{c}") for c in update_cols])
    kept = F.struct(arrival.alias("__arr"), *[F.col(c).alias(f"k_{c}") for c in keep_cols])
    ch = (changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__ck"))
          .agg(F.max(upd).alias("__new"), F.min(kept).alias("__old")))
    cols = [key, *update_cols, *keep_cols]
    s = snapshot.select(*[F.col(c).alias(f"__s_{c}") for c in cols], F.lit(True).alias("__has_s"))
    j = s.join(ch, s[f"__s_{key}"] == ch["__ck"], "full_outer")
    has_s, has_c = F.coalesce(F.col("__has_s"), F.lit(False)), F.col("__ck").isNotNull()
    out = [F.coalesce(F.col(f"__s_{key}"), F.col("__ck")).alias(key)]
    out += [F.when(has_c, F.col(f"__new.u_{x}")).otherwise(F.col(f"__s_{x}")).alias(x) for x in update_cols]
    out += [F.when(has_s, F.col(f"__s_{x}")).otherwise(F.col(f"__old.k_{x}")).alias(x) for x in keep_cols]
    action = F.when(~has_s, "insert").when(~has_c, "keep").otherwise("update")
    return j.select(*out, action.alias("action"))


# M3 ----------------------------------------------------------------------
def patch(base: DataFrame, patches: DataFrame, *, key: str | Sequence[str], cols: Sequence[str],
          patch_key: str | Sequence[str] | None = None, stamp: Column | None = None) -> DataFrame:
    """``col = COALESCE(new, old)`` per column for matched keys (one or several key columns).

    A null in the patch keeps the old value, an empty string overwrites it.
    Patches without a base row are ignored.  ``patches`` must hold one row
    per key (see :func:`newest_per_key`).  Adds ``patched`` and
    ``updated_at`` (the patch's ``stamp``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    pks = keys if patch_key is None else ([patch_key] if isinstance(patch_key, str) else list(patch_key))
    p = patches.select(*[F.col(c).alias(f"__pk{i}") for i, c in enumerate(pks)],
                       *[F.col(c).alias(f"__p_{c}") for c in cols],
                       (stamp if stamp is not None else F.current_timestamp()).alias("__stamp"),
                       F.lit(True).alias("__hit"))
    cond = [base[k] == p[f"__pk{i}"] for i, k in enumerate(keys)]
    j = base.join(p, cond, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"__p_{c}"), F.col(c)))
    return (j.withColumn("patched", F.coalesce(F.col("__hit"), F.lit(False)))
             .withColumn("updated_at", F.col("__stamp"))
             .drop("__stamp", "__hit", *[f"__pk{i}" for i in range(len(pks))], *[f"__p_{c}" for c in cols]))


# M4 / D12 ----------------------------------------------------------------
def keyed_update(base: DataFrame, keys: DataFrame, *, key: str, set_cols: Mapping[str, Column],
                 keys_key: str | None = None) -> DataFrame:
    """``UPDATE base SET ... WHERE key IN keys``; adds ``changed``."""
    kk = keys_key or key
    hit = keys.select(F.col(kk).alias("__hk")).distinct().withColumn("__hit", F.lit(True))
    j = base.join(hit, base[key] == hit["__hk"], "left")
    m = F.coalesce(F.col("__hit"), F.lit(False))
    for c, v in set_cols.items():
        j = j.withColumn(c, F.when(m, v).otherwise(F.col(c)))
    return j.withColumn("changed", m).drop("__hk", "__hit")


# M5 ----------------------------------------------------------------------
def delete_by_key(df: DataFrame, keys: DataFrame, *, key: str | Sequence[str],
                  keys_key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose (possibly composite) key is not in ``keys`` (left anti join)."""
    ks = [key] if isinstance(key, str) else list(key)
    kk = ks if keys_key is None else ([keys_key] if isinstance(keys_key, str) else list(keys_key))
    k = keys.select(*[F.col(c).alias(f"__dk{i}") for i, c in enumerate(kk)])
    return df.join(k, [df[c] == k[f"__dk{i}"] for i, c in enumerate(ks)], "left_anti")


# J9 / M6 -----------------------------------------------------------------
def cascade_delete(root_keys: DataFrame, root_key: str,
                   children: Sequence[tuple[str, DataFrame, str, str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """ON DELETE CASCADE through a chain of tables.

    ``children`` is ``[(name, table, fk_to_previous_level, own_key), ...]``.
    Returns ``{name: (removed, survivors)}``; each level is a semi / anti
    join against the keys removed one level up (no fan-out).
    """
    out = {}
    gone = root_keys.select(F.col(root_key).alias("__k"))
    for name, table, fk, own in children:
        removed = table.join(gone, table[fk] == gone["__k"], "left_semi")
        kept = table.join(gone, table[fk] == gone["__k"], "left_anti")
        out[name] = (removed, kept)
        gone = removed.select(F.col(own).alias("__k"))
    return out


def cascade_tree(root: str, root_keys: DataFrame, tables: Mapping[str, DataFrame],
                 edges: Sequence[tuple[str, str, str, str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """ON DELETE CASCADE through a tree (or acyclic graph) of foreign keys.

    ``edges`` is ``[(child, fk column, parent, referenced column), ...]``; a child may hang on several
    parents and goes if any of them does.  ``root_keys`` are the rows of ``root`` to delete.  Returns
    ``{table: (removed, survivors)}`` for the tables that hang on the root.  A row whose foreign key
    is null hangs on nothing.  Per table one semi and one anti join against the referenced values that
    go, however many parents; nothing fans out.
    """
    gone, out = {root: root_keys}, {}
    order, left = [root], {c for c, *_ in edges}
    while left:                                   # parents before children
        ready = [c for c in left if all(p in order or p not in tables and p != root for ch, _, p, _ in edges if ch == c)]
        if not ready:
            raise ValueError(f"foreign keys form a cycle among {sorted(left)}")
        order += sorted(ready)
        left -= set(ready)
    for child in order[1:]:
        table = tables[child]
        hit = None
        for _, fk, parent, ref in [e for e in edges if e[0] == child and e[2] in gone]:
            keys = gone[parent].select(F.col(ref).alias("__k")).where("__k IS NOT NULL").distinct()
            marked = table if hit is None else hit
            hit = marked.join(keys.withColumn(f"__hit_{fk}", F.lit(True)), marked[fk] == keys["__k"], "left").drop("__k")
        marks = [c for c in hit.columns if c.startswith("__hit_")]
        any_hit = F.coalesce(*[F.col(c) for c in marks], F.lit(False))
        removed, kept = hit.where(any_hit).drop(*marks), hit.where(~any_hit).drop(*marks)
        gone[child], out[child] = removed, (removed, kept)
    return out


# M9 ----------------------------------------------------------------------
def schema_evolve(old: DataFrame, new: DataFrame, *, defaults: Mapping[str, Column] | None = None,
                  drop: Sequence[str] = ()) -> DataFrame:
    """Union data written before and after ``ADD COLUMN ... DEFAULT`` / ``DROP COLUMN``."""
    u = old.unionByName(new, allowMissingColumns=True)
    for c, d in (defaults or {}).items():
        u = u.withColumn(c, F.coalesce(F.col(c), d))
    return u.drop(*drop)


# J8 ----------------------------------------------------------------------
def signup_admission(attempts: DataFrame, existing: DataFrame, *, email: str, ts: str, id_col: str,
                     existing_email: str | None = None) -> DataFrame:
    """``conflict`` (e-mail already registered), ``duplicate`` (not the first
    attempt for this e-mail in the batch) or ``created``.

    The first attempt per e-mail is a ``min(struct(ts, id))`` aggregate (map
    side partial), joined back: no sort of a whole e-mail group.
    """
    ee = existing_email or email
    known = existing.select(F.col(ee).alias("__e")).distinct().withColumn("__known", F.lit(True))
    first = attempts.groupBy(F.col(email).alias("__f_e")).agg(
        F.min(F.struct(F.col(ts).alias("t"), F.col(id_col).alias("id"))).alias("__first"))
    j = (attempts.join(known, attempts[email] == known["__e"], "left")
                 .join(first, attempts[email] == first["__f_e"], "left"))
    outcome = (F.when(F.col("__known"), "conflict")
               .when((F.col(ts) == F.col("__first.t")) & (F.col(id_col) == F.col("__first.id")), "created")
               .otherwise("duplicate"))
    return j.withColumn("outcome", outcome).drop("__e", "__known", "__f_e", "__first")


def signup_outputs(admitted: DataFrame, *, user_id: Column, email: str, ts: str, username: str | None = None,
                   fullname: str | None = None) -> dict[str, DataFrame]:
    """The rows a successful sign-up writes: user, verify token, profile, quota, mail message.

    ``username`` and ``fullname`` name columns of the attempt (by default the local part of the
    address, and an empty text)."""
    ok = admitted.filter(F.col("outcome") == "created").withColumn("__uid", user_id)
    return {
        "users": ok.select(F.col("__uid").alias("id"),
                           (F.col(username) if username else F.substring_index(email, "@", 1)).alias("username"),
                           (F.col(fullname) if fullname else F.lit("")).alias("fullname"), F.col(email).alias("email"),
                           F.lit(False).alias("is_verified"), F.lit("user").alias("role"),
                           F.col(ts).alias("created_at")),
        "verifier": ok.select(F.col("__uid").alias("user_id"),
                              F.sha2(F.col("__uid").cast("string"), 256).alias("token_hash"),
                              F.col(ts).alias("created_at"),
                              (F.col(ts) + F.expr("INTERVAL 30 MINUTES")).alias("expire_at")),
        "profiles": ok.select(F.col("__uid").alias("user_id"), F.lit("").alias("profile_pic"),
                              F.col(ts).alias("created_at")),
        "quota": ok.select(F.col("__uid").alias("user_id"), F.lit(0).alias("used_bytes"),
                           F.lit(1073741824).alias("total_bytes"), F.lit(0).alias("gif_count"),
                           F.lit(100).alias("gif_limit")),
        "messages": ok.select(F.lit("email.queue").alias("queue"),
                              F.to_json(F.struct(F.col(email).alias("to"), F.lit("signup").alias("name"),
                                                 F.col("__uid").cast("string").alias("token"))).alias("body")),
    }

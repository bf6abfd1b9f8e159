"""Snapshot mutations on edge rows."""

from pyspark.sql import functions as F

from reelspark.operators import mutate

from .conftest import T

SNAP = "user_id long, id long, file_key string, uploaded_at timestamp_ntz, duration string, thumb string"


def test_upsert_edges(spark):
    snap = spark.createDataFrame([(1, 100, "a", T("2024-01-01 00:00:00"), "1.5", "t1"),
                                  (2, 200, "b", T("2024-01-01 00:00:00"), "2.5", "t2")], SNAP)
    ch = spark.createDataFrame([
        (1, 101, "a2", T("2024-01-05 00:00:00"), "9.9", "x", 1),   # update keeps id, duration, thumb
        (3, 300, "c", T("2024-01-05 00:00:00"), "3.0", "t3", 2),   # insert
        (2, 201, "b-new", T("2024-01-09 00:00:00"), "0", "y", 3),  # two changes for one key:
        (2, 202, None, T("2024-01-02 00:00:00"), "0", "z", 4),     # later arrival, older time wins; null overwrites
    ], SNAP + ", seq long")
    out = mutate.upsert(snap, ch, key="user_id", arrival=F.col("seq"), update_cols=["file_key", "uploaded_at"],
                        keep_cols=["id", "duration", "thumb"])
    got = {r.user_id: (r.id, r.file_key, r.duration, r.thumb, r.action) for r in out.collect()}
    assert got == {1: (100, "a2", "1.5", "t1", "update"), 2: (200, None, "2.5", "t2", "update"),
                   3: (300, "c", "3.0", "t3", "insert")}


def test_patch_edges(spark):
    base = spark.createDataFrame([(1, "Ann", "a@x"), (2, "Bob", "b@x"), (3, "Cy", "c@x")],
                                 "id long, fullname string, email string")
    p = spark.createDataFrame([(1, None, "new@x"),      # null keeps
                               (2, "", None),           # '' overwrites
                               (9, "Zed", "z@x")],      # no base row: ignored
                              "id long, fullname string, email string")
    out = mutate.patch(base, p, key="id", cols=["fullname", "email"], stamp=F.lit(None).cast("timestamp"))
    got = {r.id: (r.fullname, r.email, r.patched) for r in out.collect()}
    assert got == {1: ("Ann", "new@x", True), 2: ("", "b@x", True), 3: ("Cy", "c@x", False)}


def test_cascade_edges(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    gifs = spark.createDataFrame([("g1", 1), ("g2", 1), ("g3", 3)], "key string, user_id long")
    shares = spark.createDataFrame([("s1", "g1"), ("s2", "g3"), ("s3", "g2")], "id string, gif_key string")
    gone = users.filter("id in (1, 2)")                     # user 2 has no children
    res = mutate.cascade_delete(gone, "id", [("gifs", gifs, "user_id", "key"), ("shares", shares, "gif_key", "id")])
    assert sorted(r.key for r in res["gifs"][0].collect()) == ["g1", "g2"]
    assert sorted(r.id for r in res["shares"][0].collect()) == ["s1", "s3"]
    assert [r.id for r in res["shares"][1].collect()] == ["s2"]


def test_signup_admission_edges(spark):
    att = spark.createDataFrame([(1, T("2024-01-01 00:00:00"), "a@x"), (2, T("2024-01-01 00:00:01"), "a@x"),
                                 (3, T("2024-01-01 00:00:00"), "known@x"), (4, T("2024-01-01 00:00:00"), "b@x"),
                                 (5, T("2024-01-01 00:00:00"), "b@x")], "id long, ts timestamp_ntz, email string")
    known = spark.createDataFrame([("known@x",)], "email string")
    out = mutate.signup_admission(att, known, email="email", ts="ts", id_col="id")
    got = {r.id: r.outcome for r in out.collect()}
    assert got == {1: "created", 2: "duplicate", 3: "conflict", 4: "created", 5: "duplicate"}
    made = mutate.signup_outputs(out, user_id=F.col("id"), email="email", ts="ts")
    assert made["quota"].count() == 2 and made["messages"].count() == 2


def test_insert_defaults_and_schema_evolve(spark):
    rows = spark.createDataFrame([(1, T("2024-01-01 00:00:00"), None)], "id long, created_at timestamp_ntz, used boolean")
    out = mutate.insert_defaults(rows, {"used": F.lit(False), "status": F.lit("private")}).collect()[0]
    assert out.used is False and out.status == "private"
    old = spark.createDataFrame([(1,)], "id long")
    new = spark.createDataFrame([(2, "x")], "id long, name string")
    ev = mutate.schema_evolve(old, new, defaults={"name": F.lit("")})
    assert sorted((r.id, r.name) for r in ev.collect()) == [(1, ""), (2, "x")]


def test_upsert_sink_replay_is_idempotent(spark, scratch):
    import os
    from reelspark.streaming import flows
    schema = "user_id long, id long, file_key string, seq long"
    sink = flows.upsert_sink(os.path.join(scratch, "snap"), key="user_id", arrival="seq", update_cols=["file_key"],
                             keep_cols=["id"], schema=spark.createDataFrame([], schema).schema)
    b0 = spark.createDataFrame([(1, 10, "a", 1), (2, 20, "b", 2)], schema)
    b1 = spark.createDataFrame([(1, 11, "a2", 3)], schema)
    sink(b0, 0)
    os.makedirs(os.path.join(scratch, "snap", "v00000001"))      # an attempt that died mid-write
    sink(b1, 1)
    sink(b1, 1)                                                   # replay of a finished batch: skipped
    final = spark.read.parquet(flows.latest_version(spark, os.path.join(scratch, "snap")))
    assert sorted(tuple(r) for r in final.select("user_id", "id", "file_key").collect()) == [(1, 10, "a2"), (2, 20, "b")]


def test_scoped_share_update_and_delete(spark):
    shares = spark.createDataFrame([("s1", 1, "g1", "view"), ("s2", 1, "g2", "view"), ("s3", 2, "g1", "view")],
                                   "id string, owner long, item string, access string")
    upd = spark.createDataFrame([(1, "g1", "download"), (9, "g1", "download")], "owner long, item string, access string")
    out = mutate.patch(shares, upd, key=["owner", "item"], cols=["access"], stamp=F.lit(None).cast("timestamp"))
    assert {r.id: (r.access, r.patched) for r in out.collect()} == {
        "s1": ("download", True), "s2": ("view", False), "s3": ("view", False)}
    gone = spark.createDataFrame([(1, "g2"), (2, "g9")], "owner long, item string")
    kept = mutate.delete_by_key(shares, gone, key=["owner", "item"])
    assert sorted(r.id for r in kept.collect()) == ["s1", "s3"]


def test_upsert_ties_and_null_keys_are_settled(spark):
    from pyspark.sql import functions as F
    from reelspark.operators import mutate
    snap = spark.createDataFrame([(1, "old", 10), (None, "nobody", 11)], "k long, v string, id long")
    ch = spark.createDataFrame([(1, "b", 20, 5), (1, "a", 21, 5), (2, "x", 31, 7), (2, "y", 30, 7), (None, "z", 40, 9), (3, None, 50, 1)],
                               "k long, v string, id long, arr long")
    for part in (ch, ch.orderBy(F.desc("id")).repartition(3)):
        out = mutate.upsert(snap, part, key="k", arrival=F.col("arr"), update_cols=["v"], keep_cols=["id"])
        assert sorted(map(tuple, out.collect()), key=str) == sorted(
            [(1, "b", 10, "update"), (2, "y", 30, "insert"), (3, None, 50, "insert"), (None, "nobody", 11, "keep")], key=str)


def test_cascade_tree_needs_no_order_and_finds_cycles(spark):
    import pytest
    from reelspark.operators import mutate
    t = {"b": spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "a_id long, id long"),
         "c": spark.createDataFrame([(10, None, 100), (None, 1, 200), (20, 2, 300)], "b_id long, a_id long, id long"),
         "d": spark.createDataFrame([(100, 1), (300, 2)], "c_id long, id long")}
    edges = [("d", "c_id", "c", "id"), ("c", "b_id", "b", "id"), ("c", "a_id", "a", "id"), ("b", "a_id", "a", "id")]
    out = mutate.cascade_tree("a", spark.createDataFrame([(1,)], "id long"), t, edges)
    assert {n: sorted(r.id for r in gone.collect()) for n, (gone, _) in out.items()} == {"b": [10], "c": [100, 200], "d": [1]}
    assert {n: sorted(r.id for r in kept.collect()) for n, (_, kept) in out.items()} == {"b": [20, 30], "c": [300], "d": [2]}
    with pytest.raises(ValueError):
        mutate.cascade_tree("a", spark.createDataFrame([(1,)], "id long"), t, [("b", "a_id", "c", "id"), ("c", "b_id", "b", "id")])

"""Look-ups, listings, roll-ups and planning on edge rows (FIXTURES section 4)."""

from pyspark.sql import functions as F

from reelspark.operators import lookup, media, messages, usage

from .conftest import T


def items(spark):
    rows = []
    for user, n in ((1, 19), (2, 20), (3, 21)):
        for i in range(n):
            rows.append((user, user * 100 + i, T("2024-01-01 00:00:00") if i < 3 else T(f"2024-01-02 00:{i:02d}:00"), "F" if i % 2 else "O"))
    return spark.createDataFrame(rows, "user long, id long, ts timestamp_ntz, status string")


def test_recents_19_20_21_and_equal_timestamps(spark):
    out = lookup.top_k_per_key(items(spark), "user", [F.col("ts").desc(), F.col("id").desc()], 20)
    got = {}
    for r in out.collect():
        got.setdefault(r.user, []).append((r.rn, r.id))
    assert {u: len(v) for u, v in got.items()} == {1: 19, 2: 20, 3: 20}
    # the three equal timestamps are ordered by id, newest id first
    assert sorted(got[1])[-3:] == [(17, 102), (18, 101), (19, 100)]


def test_listing_envelope_pages_and_empty_user(spark):
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    env = lookup.listing_envelope(users, items(spark), "id", "user", "ts", "id", ["id"], page_size=20)
    got = sorted((r.user_id, r.page, r.total, len(r.data)) for r in env.collect())
    assert got == [(1, 1, 19, 19), (2, 1, 20, 20), (3, 1, 21, 20), (3, 2, 21, 1), (4, 1, 0, 0)]
    last = [r for r in env.collect() if r.user_id == 3 and r.page == 2][0]
    assert last.data[0].id == 300          # the oldest item lands on the last page


def test_filter_optional(spark):
    df = items(spark)
    assert lookup.filter_optional(df, "status", "all").count() == 60
    assert lookup.filter_optional(df, "status", "").count() == 60
    assert lookup.filter_optional(df, "status", "F").count() == 29
    assert lookup.filter_optional(df, "status", "unknown").count() == 0


def test_object_readiness(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    inv = spark.createDataFrame([(1, 10), (2, 0)], "k2 long, size long")
    got = {r.k: r.state for r in lookup.object_readiness(keys, inv, "k", "k2", "size").collect()}
    assert got == {1: "ready", 2: "empty", 3: "missing"}


def test_exact_percentiles_against_numpy(spark):
    import numpy as np
    vals = [1.0, 2.0, 2.0, 3.5, 10.0, 11.0, 11.0, 11.0, 40.0]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 5.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in usage.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["b"] == (5.0, 5.0)
    assert abs(got["a"][0] - np.quantile(vals, 0.5)) < 1e-12 and abs(got["a"][1] - np.quantile(vals, 0.95)) < 1e-12


def test_conversion_plan_edges(spark):
    req = spark.createDataFrame([(1, 0.0, 3.125, 0, 0, True), (2, 0.0, 0.125, 15, 320, False),
                                 (3, 2.0, 1.0, 10, 480, True)],
                                "id long, s double, e double, fps int, width int, loop boolean")
    out = {r.id: r for r in media.conversion_plan(req, start="s", end="e", fps="fps", width="width",
                                                  loop="loop").collect()}
    assert (out[1].plan_fps, out[1].plan_width, out[1].loop_arg, out[1].t) == (10, 480, "0", "3.12")
    assert out[1].palette_filter == "fps=10,scale=480:-1:flags=lanczos,palettegen"
    assert out[1].gif_filter == "fps=10,scale=480:-1:flags=lanczos[x];[x][1:v]paletteuse"
    assert (out[2].loop_arg, out[2].t, out[2].ss) == ("-1", "0.12", "0.00")
    assert out[3].t == "-1.00"             # end before start is planned, not hidden (see validation)


def test_retry_below_at_above_max(spark):
    f = spark.createDataFrame([(1, i, T(f"2024-01-01 00:0{i}:00")) for i in range(4)] + [(2, 9, T("2024-01-01 00:00:00"))],
                              "msg long, id long, ts timestamp_ntz")
    out = messages.retry_dead_letter(f, message_key=["msg"], ts="ts", id_col="id", max_retries=2,
                                     queue=F.lit("process.queue"))
    got = {r.id: (r.retries, r.action, r.target_queue) for r in out.collect()}
    assert got == {0: (0, "requeue", "process.queue"), 1: (1, "requeue", "process.queue"),
                   2: (2, "dead", "process.queue.dead"), 3: (3, "dead", "process.queue.dead"),
                   9: (0, "requeue", "process.queue")}


def test_exact_percentiles_hot_group_continuous(spark):
    import numpy as np
    from pyspark.sql import Window  # noqa: F401
    rnd = np.random.default_rng(5)
    hot = rnd.lognormal(3, 1, 20_000)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in rnd.normal(0, 1, 50)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in usage.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p999": 0.999},
                                                   n_cuts=256).collect()}
    for g, vals in (("hot", hot), ("cold", np.array([v for k, v in rows if k == "cold"]))):
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p999", 0.999)):
            assert abs(getattr(got[g], name) - np.quantile(vals, p)) <= 1e-9 * max(1.0, abs(np.quantile(vals, p)))
    # the hot group's distinct values land in many value buckets (window tasks), not one
    cuts = df.filter("g = 'hot'").agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 2560).alias("c"))
    nb = (df.filter("g = 'hot'").crossJoin(cuts)
            .select(F.size(F.filter("c", lambda x: x <= F.col("v"))).alias("b")).distinct().count())
    assert nb > 200

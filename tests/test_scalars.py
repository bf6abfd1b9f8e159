"""Scalar functions, decoding and validation rules on edge rows."""

from pyspark.sql import functions as F

from reelspark.functions import scalars as S
from reelspark.operators import quality as Q
from reelspark.sources import messages as SM


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_range_parse_edges(spark):
    cases = [("", 10, (0, 9, 10, 200)), ("bytes=0-", 10, (0, 9, 10, 206)), ("bytes=0-5", 10, (0, 5, 6, 206)),
             ("bytes=-5", 10, (None, None, None, 416)), ("bytes=+5-", 10, (5, 9, 5, 206)),
             ("bytes=0-5,7-9", 10, (None, None, None, 416)), ("bytes=a-b", 10, (None, None, None, 416)),
             ("items=0-5", 10, (None, None, None, 416)), ("bytes=12-", 10, (None, None, None, 416)),
             ("bytes=2-50", 10, (2, 9, 8, 206)), ("", 0, (0, -1, 0, 200)), ("bytes=0-", 0, (None, None, None, 416)),
             ("bytes=99999999999999999999-", 10, (None, None, None, 416)), ("bytes=6-5", 10, (None, None, None, 416))]
    df = spark.createDataFrame([(h, n) for h, n, _ in cases], "h string, n long")
    r = S.range_parse(F.col("h"), F.col("n"))
    got = [tuple(x) for x in df.select(r["start"], r["end"], r["length"], r["code"]).collect()]
    assert got == [c[2] for c in cases]


def test_client_ip_and_bearer(spark):
    df = spark.createDataFrame([("10.0.0.7:80", "Bearer abc"), ("[::1]:80", "bearer abc"), ("noport", ""),
                                ("1.2.3.4:5", None)], "a string, h string")
    got = df.select(S.client_ip(F.col("a")), S.bearer_token(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("10.0.0.7", "abc"), ("[", None), ("noport", None), ("1.2.3.4", None)]


def test_file_ext(spark):
    got = one_col(spark, ["a.mp4", "noext", "x.tar.gz", "trailing.", "dir.v/file", ".hidden"]).select(
        S.file_ext(F.col("v"))).collect()
    assert [r[0] for r in got] == [".mp4", "", ".gz", ".", "", ".hidden"]


def test_fixed2_matches_c_printing(spark):
    vals = [3.125, 0.125, 0.375, 2.675, 1.005, -0.0, 0.0, -0.001, 10.0, 7.5]
    got = one_col(spark, vals, "float").select(S.fixed2(F.col("v"))).collect()
    # float32 values printed to 2 places, ties to even on the exact binary value
    import numpy as np
    want = ["%.2f" % float(np.float32(v)) for v in vals]
    assert [r[0] for r in got] == want


def test_content_type_and_defaults(spark):
    df = spark.createDataFrame([("video/mp4", 0, 0), ("video/avi", 15, 320), ("image/png", 0, 10)],
                               "ct string, fps int, w int")
    got = df.select(S.content_type_ext(F.col("ct")), S.default_fps(F.col("fps")),
                    S.default_width(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [("mp4", 10, 480), ("avi", 15, 320), ("", 10, 10)]


def test_retry_count(spark):
    df = spark.createDataFrame([([{"count": 2}, {"count": 9}],), ([],), (None,)], "d array<struct<count:bigint>>")
    assert [r[0] for r in df.select(S.retry_count(F.col("d"))).collect()] == [2, 0, 0]


def test_decode_edges(spark):
    bodies = ['{"to":"a","name":"signup","token":"t"}', '{"to":', '{}', '{"to":"a","extra":1}',
              '{"to":5,"name":"signup"}', '{"to":"a","name":true}', '{"to":null}']
    d = SM.decode(one_col(spark, bodies).withColumnRenamed("v", "body"), "body", SM.MAIL)
    got = [(r.valid, r.msg.to) for r in d.collect()]
    assert got == [(True, "a"), (False, None), (True, None), (True, "a"), (False, None), (False, None),
                   (True, None)]


def test_uuid_check(spark):
    vals = ["123e4567-e89b-12d3-a456-426614174000", "{123e4567-e89b-12d3-a456-426614174000}",
            "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000",
            "", "123e4567-e89b-12d3-a456-42661417400", None]
    got = [r[0] for r in one_col(spark, vals).select(S.is_uuid(F.col("v"))).collect()]
    assert got == [True, True, True, True, False, False, False]


def test_validation_rules(spark):
    rows = [("abcd", "Full Name", "a@b.io", "pass!1", "pass!1"),       # clean
            ("ab", "Full Name", "a@b.io", "pass!1", "pass!1"),         # username too short
            ("ab_d", "Nm", "bad", "pass1", "other"),                   # several rules at once
            ("ééééé", "Full Name", "a@b.io", "pass!1", "pass!1"),      # multi-byte, not alphanumeric
            (None, "", "a@b.io", "pass!1", "pass!1")]                  # null and empty
    df = spark.createDataFrame(rows, "username string, fullname string, email string, password string, "
                                     "confirm_password string")
    ok, bad = Q.split_valid(df, Q.signup_rules())
    assert ok.count() == 1
    v = {r.username: r.violations for r in bad.collect()}
    assert v["ab"] == ["username:min"]
    assert set(v["ab_d"]) == {"username:alphanum", "fullname:min", "email:email", "password:containsany",
                              "confirm_password:eqfield"}
    assert v["ééééé"] == ["username:alphanum"]
    assert set(v[None]) == {"username:required", "fullname:required"}
    _, bad_all = Q.split_valid(df, Q.signup_rules(), first_per_field=False)
    v_all = {r.username: r.violations for r in bad_all.collect()}
    assert "fullname:min" in v_all[None]


def test_metadata_enrich_edges(spark):
    from reelspark.operators import messages as M
    ok = "123e4567-e89b-12d3-a456-426614174000"
    conf = spark.createDataFrame([(1, "k1", ok), (2, "k2", ok), (3, "k3", ok), (4, "k1", "not-a-uuid")],
                                 "id long, key string, user string")
    inv = spark.createDataFrame([("k1", 100, "video/mp4"), ("k3", 0, "video/mp4")], "k string, size long, ct string")
    out = M.metadata_enrich(conf, inv, key="key", user_id="user", inv_key="k", size_col="size", type_col="ct")
    got = {r.id: (r.outcome, r.size_bytes) for r in out.collect()}
    # saved; object missing -> retry; empty object -> saved with size 0; bad user id -> reject (checked first)
    assert got == {1: ("saved", 100), 2: ("retry", None), 3: ("saved", 0), 4: ("reject", None)}


def test_length_rules_count_characters_not_bytes(spark):
    rows = [("éééé",), ("ééé",), ("é" * 20,), ("é" * 21,)]
    df = spark.createDataFrame(rows, "u string")
    rules = [("u:min", Q.too_short(F.col("u"), 4)), ("u:max", Q.too_long(F.col("u"), 20))]
    got = [r.violations for r in Q.validate(df, rules).collect()]
    assert got == [[], ["u:min"], [], ["u:max"]]


def test_decode_judges_top_level_fields_only(spark):
    rows = [(1, '{"name":"signup","to":"a","token":"t","meta":{"name":5}}'), (2, '{"To":"a","Name":"b","TOKEN":null}'), (3, '{"name":5}'), (4, "null"),
            (5, "{}"), (6, "[1]"), (7, '{"name":'), (8, None), (9, '"text"'), (10, '{"name":"x\\"name\\": 5"}')]
    from reelspark.sources import messages as SM
    out = {r.id: (r.valid, r.msg.to, r.msg.name) for r in SM.decode(spark.createDataFrame(rows, "id long, body string"), "body", SM.MAIL).collect()}
    assert out == {1: (True, "a", "signup"), 2: (True, "a", "b"), 3: (False, None, None), 4: (True, None, None), 5: (True, None, None),
                   6: (False, None, None), 7: (False, None, None), 8: (False, None, None), 9: (False, None, None), 10: (True, None, 'x"name": 5')}
    conv = [(1, '{"start_time":1,"end_time":2.5,"width":480,"loop":true}'), (2, '{"width":4.5}'), (3, '{"loop":"yes"}'), (4, '{"fps":99999999999}')]
    got = {r.id: (r.valid, r.msg.start_time, r.msg.width) for r in SM.decode(spark.createDataFrame(conv, "id long, body string"), "body", SM.CONVERSION).collect()}
    assert got == {1: (True, 1.0, 480), 2: (False, None, None), 3: (False, None, None), 4: (False, None, None)}


def test_rules_of_every_record(spark):
    good = dict(username="user1", fullname="Some One", email="a@b.io", password="Secret!1", confirm_password="Secret!1", token="t", current_password="oldone",
                filename="f", content_type="video/mp4", key="k", role="user")
    bad = dict.fromkeys(good, "")
    df = spark.createDataFrame([good, bad])
    for record in Q.RECORD_RULES:
        got = {r.email: r.violations for r in Q.validate(df, Q.record_rules(record)).select("email", "violations").collect()}
        assert got["a@b.io"] == [] and got[""], record
    assert spark.range(50).select(S.random_uuid().alias("u")).distinct().where(S.is_uuid(F.col("u"))).count() == 50


def test_published_messages_are_read_back(spark, scratch):
    from reelspark.sources import messages as SM
    enc = SM.encode(spark.range(3), {"name": F.lit("signup"), "to": F.col("id").cast("string")}, "email.queue")
    SM.publish(enc, scratch + "/q")
    back = SM.decode(spark.read.text(scratch + "/q"), "value", SM.MAIL)
    assert sorted(r.msg.to for r in back.collect()) == ["0", "1", "2"] and {r.queue for r in back.select("queue").collect()} == {"email.queue"}

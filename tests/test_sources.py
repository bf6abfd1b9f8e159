"""Strict decoding, publishing once, listings with empty objects, UUID ranges."""

import os

import pytest
from pyspark.sql import functions as F

from reelspark.operators import quality as Q
from reelspark.plans.messages import _bodies
from reelspark.sources import connectors, listing, tables
from reelspark.sources import messages as SM

from .conftest import SF001

BODIES = [  # body, to (None: invalid)
    ('{"to":"a","name":"signup"} x', None), ('{"to":"a"}{"to":"b"}', None), ('{"to":"a","to":"b"}', "b"), ('{"TO":"a","to":"b"}', "b"),
    ('{"to":"a","TO":"b"}', "b"), ('{"to":"a","to":null}', "a"), ('{"to":1,"to":"a"}', None), ('{"to":"a"}\n\t ', "a"), ("null", ""), (" null ", ""), ("{}", ""),
    ("[]", None), ("1", None), ('"x"', None), ("", None), (None, None), ('{"to":"a"} , "end":1}', None), ('{"to":"a"', None), ('{"to":"a",}', None),
    ('{"to":"a","x":[1,{"b":null}]}', "a"), ('{"to":{"a":1}}', None), ('{"a":1}] x [', None), ("nul", None), ('{"To":"\\u00e9"}', "é")]


def test_only_one_whole_object_is_valid(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(BODIES)], "k int, body string")
    got = {r.k: (r.msg.to or "") if r.valid else None for r in SM.decode(df, "body", SM.MAIL).collect()}
    assert got == {k: to for k, (_, to) in enumerate(BODIES)}


ADDRESSES = {  # the validator's own cases
    "test@mail.com": True, "Dörte@Sörensen.example.com": True, "θσερ@εχαμπλε.ψομ": True, "юзер@екзампл.ком": True, "उपयोगकर्ता@उदाहरण.कॉम": True,
    "用户@例子.广告": True, "mail@domain_with_underscores.org": True, "first.last+tag@sub-1.example.org": True, '"test test"@email.com': True,
    '"@email.com': False, '""@email.com': False, "": False, "test@email": False, "test@email.": False, "@email.com": False, ".a@b.c": False, "a.@b.c": False,
    "a..b@c.d": False, "a@b..c": False, "a@-.c": False, "a@-b.c": False, "a@b.c1": False, "a@b-.c": False, "a b@c.d": False, "a@b c.d": False, "a@@b.c": False,
    "a@b.c\n": False, "no-at": False, "a@" + "b." * 20000 + "1": False, "a" * 50000 + "@b.c": True}


def test_email_rule(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    assert {r.a: not r.bad for r in df.select("a", Q.not_email(F.col("a")).alias("bad")).collect()} == ADDRESSES


def encoded(spark):
    ev = tables.read_table(spark, SF001, "events")
    return _bodies(ev).select(F.when(F.col("event_id") % 3 == 0, "save.queue").otherwise("email.queue").alias("queue"), "body")


def lines(df):
    return sorted((r.queue, r.body) for r in df.select("queue", "body").collect())


def test_a_replayed_batch_publishes_once(spark, scratch):
    sink, rows = SM.publish_sink(scratch), encoded(spark)
    assert SM.published(spark, os.path.join(scratch, "none")).count() == 0
    sink(rows, 3)
    sink(rows, 3)                                                          # a replay
    assert lines(SM.published(spark, scratch)) == lines(rows)
    os.remove(os.path.join(scratch, "batch=000000000003", "_SUCCESS"))     # as an attempt that died before its end leaves it
    sink(rows.limit(5), 4)
    assert SM.published(spark, scratch).count() == 5
    sink(rows, 3)
    assert lines(SM.published(spark, scratch).where("batch = 3")) == lines(rows)


def test_a_stream_publishes_once_also_after_a_lost_commit(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, n) for n in ("src", "out", "ckpt"))
    encoded(spark).repartition(3).write.parquet(src)

    def run():
        st = spark.readStream.schema(encoded(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
        SM.publish_stream(st, out, ckpt).trigger(availableNow=True).start().awaitTermination(300)
    run()
    last = sorted((n for n in os.listdir(os.path.join(ckpt, "commits")) if n.isdigit()), key=int)[-1]
    for name in (last, f".{last}.crc"):                                    # the last batch is run again
        if os.path.exists(os.path.join(ckpt, "commits", name)):
            os.remove(os.path.join(ckpt, "commits", name))
    run()
    back = spark.read.schema("body string, queue string").option("basePath", out).text(out)
    assert lines(back) == lines(encoded(spark))


def test_listing_has_empty_objects(spark, scratch):
    for name, data in (("a/b/full.bin", b"1234"), ("a/empty.bin", b""), ("top.txt", b"x"), ("c/_hidden/x", b"zz"), ("c/.dot", b"z"), ("d e/ü.txt", b"")):
        path = os.path.join(scratch, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    df = listing.listing(spark, scratch)
    assert sorted((r.key, r.size) for r in df.collect()) == [("a/b/full.bin", 4), ("a/empty.bin", 0), ("d e/ü.txt", 0), ("top.txt", 1)]
    assert df.rdd.getNumPartitions() == 4                                   # one a folder of the first level, one for the objects in it
    assert listing.listing(spark, "file://" + scratch, hidden=True).count() == 6
    assert listing.listing(spark, os.path.join(scratch, "missing")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_uuid_ranges_split_all_ids(spark, n):
    ids = spark.range(300).select(F.expr("uuid()").alias("id")).union(spark.createDataFrame(
        [("00000000-0000-0000-0000-000000000000",), ("ffffffff-ffff-ffff-ffff-ffffffffffff",), (None,)], "id string")).toPandas()
    df = spark.createDataFrame(ids, "id string")
    sizes = [df.where(p).count() for p in connectors.uuid_ranges("id", n)]
    assert sum(sizes) == 303 and len(sizes) == n and min(sizes) > 300 / n / 3

"""Language ID and toxicity by held-out accuracy; mixing by its expectation; edge rows of each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm.langid import language_id, training_rows
from reelspark.llm.mixing import poisson_mix
from reelspark.llm.toxicity import score_toxicity

from ..conftest import SF01


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    r = language_id(docs, training_rows()).where(~training_rows()).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.sum(F.col("lang_rejected").cast("int")).alias("gone"),
        F.min("lang_score").alias("lo"), F.max("lang_score").alias("hi")).first()
    assert r.acc > 0.97 and r.gone <= 5 and 0 <= r.lo <= r.hi <= 1


def test_language_id_edge_rows(spark):
    rows = [(1, "the cat and the dog and the house", "en"), (3, "le chat et le chien et la maison", "fr"), (4, None, "en"), (5, "", None), (6, "123 ... 45", "en"),
            (None, "THE DOG AND THE CAT", None), (6, "le chien et le chat " * 3000, "zz"), (6, "²½", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    train = F.col("doc_id").isin(1, 3)
    got = [(r.doc_id, r.lang_pred, r.lang_rejected) for r in language_id(df, train).collect()]
    assert sorted(got, key=str) == sorted([(1, "en", False), (3, "fr", False), (4, "und", True), (5, "und", True), (6, "und", True), (None, "en", False),
                                           (6, "fr", False), (6, "und", True)], key=str)
    assert {r.lang_pred for r in language_id(df, F.lit(False)).collect()} == {"und"}
    assert language_id(df.limit(0), train).count() == 0


def test_language_id_rejects_mixed_foreign_and_junk(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    rng = random.Random(3)
    clean = docs.where(~training_rows() & (F.length("text") >= 800)).orderBy("doc_id").collect()
    by = {lang: [r.text[:2000] for r in clean if r.lang == lang] for lang in {r.lang for r in clean if r.lang}}
    langs = sorted(by)
    mixed = [" ".join(x for k in (0, 400) for x in (a[k:k + 400], b[k:k + 400]))
             for i, lang in enumerate(langs) for a, b in zip(by[lang][:8], by[langs[i - 1]][:8])]
    halves = [a[:800] + " " + b[:800] for i, lang in enumerate(langs) for a, b in zip(by[lang][:8], by[langs[i - 1]][:8])]
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in [30, 200, 3000] * 5]
    foreign = ["Это русское предложение, которого модель никогда не видела и которое надо отклонить. ",
               "Αυτή είναι μια πρόταση που το μοντέλο δεν έχει δει ποτέ. ", "这是一个模型从未见过的句子,应该被拒绝。"]
    made = [(f"{kind}-{i}", t, None) for kind, texts in (("mixed", mixed), ("halves", halves), ("junk", junk), ("foreign", foreign)) for i, t in enumerate(texts)]
    got = language_id(docs.union(spark.createDataFrame(made, docs.schema)), training_rows() & ~F.col("doc_id").contains("-")).collect()
    gone = {r.doc_id: r.lang_rejected for r in got}
    share = {kind: sum(v for k, v in gone.items() if k.startswith(kind)) / len(texts)
             for kind, texts in (("mixed", mixed), ("halves", halves), ("junk", junk), ("foreign", foreign))}
    assert share["junk"] == share["foreign"] == 1 and share["mixed"] > 0.8 and share["halves"] > 0.8, share
    assert sum(gone[r.doc_id] for r in clean) <= 5


def toxic_rows():
    rng = random.Random(1)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        ws = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws += ["insult"] * insult + ["groupname"] * group
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(insult and group)))   # toxic only together: a pairwise interaction
    return rows, labels


def test_interaction_of_two_terms(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tox_score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, lab, F.col("doc_id") % 3 != 0).collect()}
    truth = dict(labels)
    held = [i for i in truth if i % 3 == 0]
    assert sum(got[i].tox_predicted == truth[i] for i in held) / len(held) > 0.97


def test_interaction_with_many_rare_terms(spark):
    """Each group name is too rare for an association of its own, but is toxic together with the insult."""
    rng = random.Random(5)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{k * 7919 % 1000}q" for k in range(600)]
    names = ["".join(rng.choice("bcdfghjklmnp") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    rows, truth = [], {}
    for i in range(9000):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.2, rng.random() < 0.4
        ws += ["insult"] * insult + [rng.choice(names)] * group
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        truth[i] = int(insult and group)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.tox_predicted for r in score_toxicity(docs, lab, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in truth if i % 5 == 0]
    toxic = [i for i in held if truth[i]]
    assert sum(got[i] for i in toxic) / len(toxic) > 0.9
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.97


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame([(1, "fine"), (2, None), (3, ""), (None, "bad " * 20000), (1, "fine"), (4, "...")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)], [(1, None), (None, 1)]):
        out = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
        assert len(out) == 6 and all(0 <= r.tox_score <= 1 and r.tox_predicted == int(r.tox_score >= 0.5) for r in out)
    assert score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    out = score_toxicity(docs, labels, F.col("doc_id") % 5 != 0).join(labels, "doc_id").where("lang = 'en' and quality = 1").where(F.col("doc_id") % 5 == 0)
    r = out.agg(F.avg((F.col("tox_predicted") == F.col("toxic")).cast("int")).alias("acc")).first()
    assert r.acc > 0.95


def test_mixing_meets_its_targets(spark):
    rows = [(i, "x" * (10 + i % 7), f"s{i % 3}" if i % 3 else None, 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_rate int")
    out = poisson_mix(df, {"s1": 2.0, None: 1.0}, default_weight=1.0, total_mass=200_000)
    mass = {r.source: r.m for r in out.groupBy("source").agg(F.sum(F.length("text") + 1).alias("m")).collect()}
    for source, share in (("s1", 0.5), ("s2", 0.25), (None, 0.25)):
        assert mass[source] == pytest.approx(200_000 * share, rel=0.05)
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    n = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mix_copies").alias("c"))
    assert n.where("n <> c").count() == 0


def test_mixing_edge_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "t" * 100_000, "b"), (3, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = poisson_mix(df, total_mass=5e6)
    assert out.groupBy("source").count().count() == 3       # rates far over one: nothing is lost
    assert out.where("doc_id = 1").select("mix_copies").distinct().count() == 1
    a = out.where("source = 'a'").count()
    assert a == pytest.approx(5e6 / 3 * 1.0, rel=0.01)      # three documents of mass one each
    assert poisson_mix(df.limit(0)).count() == 0


def test_scoring_tasks_share_one_machine(spark):
    """The kernel that goes to every task is small: the machine's parameters are broadcast, not pickled with it."""
    from pyspark import cloudpickle
    from reelspark.llm import toxicity
    kept, real = [], toxicity.FactorizationMachine.raw
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 997}" for j in range(60))) for k in range(1, 400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 400)], "doc_id long, toxic int")

    def caught(self, func, schema, *args, **kw):
        kept.append(len(cloudpickle.dumps(func)))
        return real_map(self, func, schema, *args, **kw)
    kind = type(docs)
    real_map = kind.mapInArrow
    kind.mapInArrow = caught
    try:
        out = toxicity.score_toxicity(docs, labels, F.lit(True))
    finally:
        kind.mapInArrow = real_map
    model = toxicity.train(docs, labels, F.lit(True))
    again = toxicity.FactorizationMachine.of(model.slots, model.w0, model.w, model.v)
    assert len(model.slots) > 500 and kept[-1] < len(model.slots) * 40
    pairs = (np.array([0, 0, 1]), np.array([1, 5, 3]), 2)
    assert real(again, *pairs) == pytest.approx(real(model, *pairs))
    assert out.count() == 399

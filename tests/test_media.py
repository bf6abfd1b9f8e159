"""Media re-aims: frame grids, resampling and codebooks on edge rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from reelspark.operators import media

from .conftest import SF001, T


def test_frame_grid_edges(spark):
    req = spark.createDataFrame([(1, 0.0, 0.0, 10), (2, 0.0, 0.1, 10), (3, 1.0, 0.25, 10), (4, 0.0, -1.0, 10)],
                                "id long, start double, dur double, fps int")
    out = media.frame_grid(req, start=F.col("start"), duration=F.col("dur"), fps=F.col("fps"))
    got = sorted((r.id, r.frame, r.t_ms) for r in out.collect())
    # zero frames -> no rows; one frame; fractional last frame rounds up; negative -> none
    assert got == [(2, 0, 0), (3, 0, 1000), (3, 1, 1100), (3, 2, 1200)]


def test_series_resample_as_of(spark):
    s = spark.createDataFrame([(1, T("2024-01-01 00:00:00"), 1, 1.0), (1, T("2024-01-01 06:00:00"), 2, 2.0),
                               (1, T("2024-01-01 07:00:00"), 3, 3.0)], "k long, ts timestamp_ntz, id long, v double")
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    from reelspark.functions.timecols import ntz
    out = media.series_resample(s, keys, key="k", ts="ts", id_col="id", value="v",
                                grid_start=ntz("2024-01-01 00:00:00"), grid_end=ntz("2024-01-01 12:00:00"),
                                step="6 HOURS")
    got = sorted((r.k, r.t.hour, r.v) for r in out.collect())
    assert got == [(1, 0, 1.0), (1, 6, 2.0), (1, 12, 3.0), (2, 0, None), (2, 6, None), (2, 12, None)]


def test_codebook_assign_nearest(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    book = media.codebook_means(emb, vec="embedding", group="label")
    codes = {c.code: c.center for c in book.collect()}
    got = media.codebook_assign(emb, book, vec="embedding").collect()
    for r in got[:50]:
        d = {c: sum((a - b) ** 2 for a, b in zip(r.embedding, ctr)) for c, ctr in codes.items()}
        best = min(d.values())
        assert math.isclose(d[r.code], best, rel_tol=1e-9)


def test_codebook_kmeans_plugs_into_assign(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    book = media.codebook_kmeans(emb, vec="embedding", k=8)
    codes = {c.code: c.center for c in book.collect()}
    assert len(codes) == 8
    out = media.codebook_assign(emb, book, vec="embedding")
    assert out.count() == emb.count()
    r = out.first()
    d = {c: sum((a - b) ** 2 for a, b in zip(r.embedding, ctr)) for c, ctr in codes.items()}
    assert d[r.code] == min(d.values())


def test_codebook_blocks_agree(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    book = media.codebook_means(emb, vec="embedding", group="vec_id")       # far more codes than one block takes
    one = {r.vec_id: r.code for r in media.codebook_assign(emb, book, vec="embedding").collect()}
    many = {r.vec_id: r.code for r in media.codebook_assign(emb, book, vec="embedding", block_values=64 * 9).collect()}
    assert one == many and all(k == c for k, c in one.items())


def test_frame_grid_blocks(spark):
    req = spark.createDataFrame([(1, 2501.0)], "id long, dur double")
    out = media.frame_grid(req, start=F.lit(0.0), duration=F.col("dur"), fps=F.lit(1))
    assert sorted(r.frame for r in out.collect()) == list(range(2501))


def plain_median_cut(rows, codes):
    """Box by box in plain Python: the widest box at the median of its widest position."""
    boxes = {0: dict(rows)}
    while len(boxes) < codes:
        spans = [(-(max(v[p] for v in b.values()) - min(v[p] for v in b.values())), n, p) for n, b in boxes.items() if b for p in range(len(next(iter(b.values()))))]
        w, n, p = min(spans)
        if w == 0:
            break
        values = sorted(v[p] for v in boxes[n].values())
        cut, hi = statistics.median(values), values[-1]
        up = {k for k, v in boxes[n].items() if v[p] > cut or (cut == hi and v[p] == hi)}
        boxes[len(boxes)] = {k: v for k, v in boxes[n].items() if k in up}
        boxes[n] = {k: v for k, v in boxes[n].items() if k not in up}
    return {k: n for n, b in boxes.items() for k in b}


@pytest.mark.parametrize("codes, kind", [(1, "any"), (9, "any"), (5, "ties"), (6, "same"), (4, "few")])
def test_median_cut_equals_the_plain_version(spark, codes, kind):
    rng = random.Random(codes)
    rows = {"any": [(k, [rng.gauss(0, 1 + 3 * (p == 2)) for p in range(4)]) for k in range(300)],
            "ties": [(k, [float(rng.choice([0, 0, 0, 9])), float(rng.randrange(3))]) for k in range(200)],
            "same": [(k, [1.5, 2.5]) for k in range(20)], "few": [(k, [float(k % 2), 0.0]) for k in range(10)]}[kind]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    cuts = media.median_cut(df, vec="v", codes=codes)
    got = {r.id: r.code for r in media.median_cut_assign(df, cuts, vec="v").collect()}
    assert got == plain_median_cut(rows, codes)
    book = {r.code: r.center for r in media.codebook_means(media.median_cut_assign(df, cuts, vec="v"), vec="v", group="code").collect()}
    assert set(book) == set(got.values())

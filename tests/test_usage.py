"""Exact percentiles on groups that are null, all null, constant, tied and skewed."""

import numpy as np
import pytest

from reelspark.operators import usage


def test_exact_percentiles_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000).tolist(), "tied": [1.0] * 500 + [2.0] * 499 + [3.0], "one": [7.0], "two": [1.0, 2.0],
              None: rng.integers(0, 5, 400).astype(float).tolist(), "empty": [None, None], "mixed": [None, 5.0, None, 6.0, 8.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    for bound in (10_000, 0):          # with and without broadcasts
        monkeypatch.setattr(usage, "BROADCAST_GROUPS", bound)
        got = {r.g: r for r in usage.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, n_cuts=16).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            known = [v for v in vs if v is not None]
            assert got[g].n == len(vs)
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0), ("p100", 1.0)):
                want = np.quantile(known, p) if known else None
                assert got[g][name] == (pytest.approx(want) if known else None), (g, name)
            assert got[g].max_value == (max(known) if known else None)


def test_empty_log(spark):
    assert usage.request_rollup(spark.createDataFrame([], "g string, v double"), group_col="g", value_col="v").count() == 0

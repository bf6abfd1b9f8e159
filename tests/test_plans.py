"""Plan shape: the physical plans we rely on at scale."""

import __spark_entry__ as E

from .conftest import SF01


def plan(spark, name):
    df = E.queries()[name](spark, SF01)
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_user_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "recents_per_user")


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan(spark, "list_by_status")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p


def test_optional_filter_folds_away_for_all(spark):
    p = plan(spark, "list_by_status_all")
    assert "Filter " not in p and "PushedFilters: []" in p


def test_no_cartesian_products(spark):
    from reelspark.plans import QUERIES
    for name in QUERIES:
        if name in ("object_inventory", "codebook_assign"):
            continue
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_codebook_is_single_broadcast_row(spark):
    p = plan(spark, "codebook_assign")
    assert "BroadcastNestedLoopJoin" in p and "CartesianProduct" not in p


def test_fold_summary_shares_the_shuffle(spark):
    df = E.queries()["token_bucket"](spark, SF01)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "MapInPandas" in final
    # one scan of events feeds the whole fold: the per-bucket summaries reuse
    # the rows' shuffle instead of re-reading and re-shuffling the input
    assert final.count("FileScan parquet") == 1
    assert "ReusedExchange" in final

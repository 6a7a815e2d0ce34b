"""Plan checks: no keyless joins, pruned scans, bounded top-k."""

import pytest

from tests.conftest import SF_SMALL

KEYLESS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as se
    return se.queries()


@pytest.mark.parametrize("name", ["extract_subset", "item_liking", "play_histogram", "popularity_curve",
                                  "popularity_curve_subsets", "recommend_popular_occ", "recommend_random",
                                  "evaluate_popular", "split_train", "group_users", "ragged_slice",
                                  "user_similarity", "frequent_summary", "k_similar_items"])
def test_no_keyless_join(spark, registry, name):
    plan = _plan(registry[name](spark, SF_SMALL))
    assert not any(k in plan for k in KEYLESS), plan


def test_scan_reads_only_needed_columns(spark, registry):
    plan = _plan(registry["song_play_mean"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_topk_is_group_limited(spark):
    from playlens.operators.coverage import _top_by_occurrence
    from playlens.sources import fixtures as fx
    df = _top_by_occurrence(fx.plays_subsets(spark, SF_SMALL), 200)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_semi_joins_for_existence(spark, registry):
    plan = _plan(registry["extract_subset"](spark, SF_SMALL))
    assert "LeftSemi" in plan


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.columns == ["user_id", "item_id", "play_count"]
    assert df.count() == 658


def test_als_lists_without_keyless_join(spark, registry):
    plan = _plan(registry["recommend_als"](spark, SF_SMALL))
    assert not any(k in plan for k in KEYLESS), plan

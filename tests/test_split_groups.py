from collections import Counter

import pytest
from pyspark.sql import functions as F

from playlens.functions.aggregates import GROUP_AGGREGATES
from playlens.functions.numbering import global_index, rank_within
from playlens.operators import groups, split, stats
from tests.conftest import rows_of


def _user_rows(spark, sizes):
    rows = [(u, i, 1) for u, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "user_id BIGINT, item_id BIGINT, play_count INT")


def test_split_sizes_round_half_even(spark):
    df = _user_rows(spark, list(range(1, 12)))
    out = split.split_train_test(df, 0.5, 42)
    train = Counter(r["user_id"] for r in out.filter(F.col("split") == "train").collect())
    assert [train.get(u, 0) for u in range(11)] == [0, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6]
    assert out.count() == sum(range(1, 12))


def test_split_is_deterministic_and_disjoint(spark):
    df = _user_rows(spark, [7, 13, 3])
    a = rows_of(split.split_train_test(df, 0.5, 7), "user_id", "item_id", "split")
    b = rows_of(split.split_train_test(df, 0.5, 7), "user_id", "item_id", "split")
    assert a == b
    assert len({(u, i) for u, i, _ in a}) == len(a) == 23


def test_split_same_with_forced_salting(spark):
    df = _user_rows(spark, [7, 13, 3, 40])
    plain = rows_of(split.split_train_test(df, 0.5, 3), "user_id", "item_id", "split")
    salted = rows_of(split.split_train_test(df, 0.5, 3, max_window_rows=2), "user_id", "item_id", "split")
    assert plain == salted
    f1 = rows_of(split.cv_folds(df, 5, 3), "user_id", "item_id", "fold")
    f2 = rows_of(split.cv_folds(df, 5, 3, max_window_rows=2), "user_id", "item_id", "fold")
    assert f1 == f2


def test_fold_sizes(spark):
    df = _user_rows(spark, [7, 13, 3])
    out = split.cv_folds(df, 5, 42)
    sizes = Counter((r["user_id"], r["fold"]) for r in out.collect())
    assert [sizes.get((0, f), 0) for f in range(5)] == [1, 2, 1, 2, 1]
    assert [sizes.get((1, f), 0) for f in range(5)] == [3, 2, 3, 2, 3]
    assert [sizes.get((2, f), 0) for f in range(5)] == [1, 0, 1, 0, 1]
    k0 = split.cv_fold_test(out, 0).count() + split.cv_fold_train(out, 0).count()
    assert k0 == 23


def test_rank_within_hot_group_matches_brute_force(spark):
    # one user holds a third of all rows
    rows = [(0, i) for i in range(3000)] + [(u, i) for u in range(1, 600) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id BIGINT, item_id BIGINT").withColumn(
        "k", F.md5(F.concat_ws(":", F.lit("s"), "user_id", "item_id")))
    got = {(r["user_id"], r["item_id"]): (r["rank"], r["group_size"])
           for r in rank_within(df, ["user_id"], "k", ["item_id"]).collect()}
    import hashlib
    by_user = {}
    for u, i in rows:
        by_user.setdefault(u, []).append((hashlib.md5(f"s:{u}:{i}".encode()).hexdigest(), i))
    for u, lst in by_user.items():
        for pos, (_, i) in enumerate(sorted(lst), start=1):
            assert got[(u, i)] == (pos, len(lst))


def test_global_index_dense_ordered(spark):
    ids = spark.createDataFrame([(x,) for x in [50, 3, 17, 99, 2, 64, 8]], "id BIGINT")
    out = rows_of(global_index(ids, ["id"], "idx", num_partitions=3), "id", "idx")
    assert out == [(2, 0), (3, 1), (8, 2), (17, 3), (50, 4), (64, 5), (99, 6)]


def test_groups_partition_users(spark):
    users = spark.createDataFrame([(u,) for u in range(10)], "id BIGINT")
    g = groups.group_users(users, 4, 1).collect()
    sizes = sorted(Counter(r["group_id"] for r in g).values(), reverse=True)
    assert sizes == [4, 4, 2]
    assert sorted(r["user_id"] for r in g) == list(range(10))
    users8 = spark.createDataFrame([(u,) for u in range(8)], "id BIGINT")
    assert sorted(Counter(r["group_id"] for r in groups.group_users(users8, 4, 1).collect()).values()) == [4, 4]


def test_group_aggregates_hand_case(spark, T):
    membership = spark.createDataFrame([(0, 1), (0, 2)], "group_id BIGINT, user_id BIGINT")
    gp = groups.form_groups(T.withColumn("split", F.lit("train")), membership)
    weights = groups.group_weights(membership, stats.user_play_mean(T))
    expected = {"avg": 7.0, "normalized_avg": 13.316807, "least_misery": 2.0, "median": 7.0,
                "weighted_avg": 1.410714}
    for agg in GROUP_AGGREGATES:
        got = {r["item_id"]: r["score"] for r in groups.group_aggregate_scores(gp, agg, weights).collect()}
        assert got[1] == pytest.approx(expected[agg], abs=1e-6), agg
    with pytest.raises(ValueError):
        groups.group_aggregate_scores(gp, "mode")


def test_split_keys_are_made_after_the_rows_are_dealt(spark, T):
    plan = split.split_train_test(T, 0.5, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("RepartitionByExpression")  # the key lies above the exchange

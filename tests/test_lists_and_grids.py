"""Full kNN lists, one shared list from the labels' side, batched cross-validation,
and one ranking rule however the sparse product is tiled."""

import random

import pytest
from pyspark.sql import functions as F

from playlens.operators import metrics, recommend, similarity, tuning
from playlens.operators.sparse_product import sparse_product
from playlens.operators.stats import song_play_mean


def test_padded_list_of_the_hand_case(spark, T):
    w = similarity.log_weights(T)
    nb = similarity.k_similar_items(w, 2)
    got = {(r["row"], r["rank"]): (r["item_id"], round(r["score"], 6)) for r in recommend.recommend_knn(w, nb, 3, pad=True).collect()}
    assert got[2, 1] == (3, 0.604674) and got[2, 2] == (4, 0.0) and (2, 3) not in got
    assert (2, 2) not in {(r["row"], r["rank"]) for r in recommend.recommend_knn(w, nb, 3).collect()}


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_padding_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(recommend, "PAD_BLOCK", block)
    rng = random.Random(3)
    items = rng.sample(range(1000), 40)
    played = {(r, i) for r in range(8) for i in rng.sample(items, rng.choice([0, 1, 5, 20, 38, 40])) } | {(8, items[0])}
    rows = sorted({r for r, _ in played})
    listed = {r: rng.sample(sorted(set(items) - {i for q, i in played if q == r}), min(rng.randrange(5), 40 - sum(q == r for q, _ in played))) for r in rows}
    lists = spark.createDataFrame([(r, k + 1, i, 1.0) for r in rows for k, i in enumerate(listed[r])] or [(0, 1, 1, 1.0)], "row long, rank int, item_id long, score double")
    out = recommend.pad_lists(lists, spark.createDataFrame(sorted(played), "row long, item_id long"),
                              spark.createDataFrame([(i,) for i in items], "item_id long"), 12).collect()
    for r in rows:
        free = sorted(set(items) - {i for q, i in played if q == r} - set(listed[r]))
        want = (listed[r] + free)[:12]
        assert [x["item_id"] for x in sorted((x for x in out if x["row"] == r), key=lambda x: x["rank"])] == want


def test_same_list_metrics_equal_the_long_form(spark):
    rng = random.Random(2)
    ranked = spark.createDataFrame([(k + 1, i) for k, i in enumerate(rng.sample(range(60), 25))], "rank int, item_id long")
    entities = spark.createDataFrame([(e,) for e in range(9)] + [(3,)], "entity long")
    labels = spark.createDataFrame([(e, rng.randrange(60)) for e in (0, 1, 2, 3, 4, 5, 99) for _ in range(rng.randrange(1, 15))], "entity long, item_id long")
    lists = entities.distinct().join(ranked.withColumn("x", F.lit(1)), F.lit(True)).select("entity", "rank", "item_id")
    for lab in (labels, labels.limit(0)):
        a = metrics.evaluate_at(lists, lab, (5, 20, 50)).orderBy("n").collect()
        b = metrics.evaluate_same_list(ranked, entities, lab, (5, 20, 50)).orderBy("n").collect()
        for x, y in zip(a, b, strict=True):
            for c in x.asDict():
                assert x[c] == pytest.approx(y[c], abs=1e-12) if x[c] is not None else y[c] is None, (c, x, y)


def test_cross_validation_scores_each_fold_and_set(spark):
    rng = random.Random(6)
    rows = sorted({(u, rng.randrange(30)) for u in range(12) for _ in range(14)})
    folded = spark.createDataFrame([(u, i, rng.randrange(1, 9), (u + i) % 3) for u, i in rows], "entity long, item_id long, score int, fold int")
    grid = ("occ", "tot", "mean")
    got = {(r["fold"], r["param_id"]): (r["map"], r["mpr"]) for r in tuning.cross_validate(folded, grid, n=7, fit=tuning.popular_lists(7)).collect()}
    assert set(got) == {(k, p) for k in range(3) for p in range(3)}
    for k in range(3):
        train, test = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        stats = song_play_mean(train.select(F.col("entity").alias("user_id"), "item_id", F.col("score").alias("play_count")))
        for p, by in enumerate(grid):
            one = metrics.evaluate_at(recommend.recommend_popular(train.select("entity").distinct(), stats, by, 7), test, [7]).first()
            assert got[k, p] == pytest.approx((one["map"], one["mpr"]), abs=1e-12)


CHUNKS = [{}, {"chunk_entries": 8}, {"chunk_entries": 4}, {"chunk_entries": 2, "heavy_key": 2}]


@pytest.mark.parametrize("tiling", CHUNKS)
def test_large_values_rank_alike_however_tiled(spark, tiling):
    x = spark.createDataFrame([(0, t, 1e5) for t in range(3)], "r long, t long, x double")
    y = spark.createDataFrame([(q, t, 1e5 + q) for q in range(1, 7) for t in range(3)], "q long, t long, y double")
    got = [(r["q"], r["rank"]) for r in sparse_product(x, y, k=4, **tiling).orderBy("rank").collect()]
    assert got == [(6, 1), (5, 2), (4, 3), (3, 4)]


@pytest.mark.parametrize("tiling", CHUNKS)
def test_cancelling_sums_and_ties_however_tiled(spark, tiling):
    values = [0.1, 0.2, -0.3, 0.7, -0.7, 0.4, -0.4]
    x = spark.createDataFrame([(0, t, v) for t, v in enumerate(values)] + [(1, t, 0.1) for t in range(3)] + [(2, 0, 0.3)], "r long, t long, x double")
    y = spark.createDataFrame([(q, t, 1.0) for q in (5, 3) for t in range(len(values))], "q long, t long, y double")
    top = sorted((r["r"], r["rank"], r["q"]) for r in sparse_product(x, y, k=2, **tiling).collect())
    assert top == [(1, 1, 3), (1, 2, 5), (2, 1, 3), (2, 2, 5)]
    assert sorted((r["r"], r["q"]) for r in sparse_product(x, y, **tiling).collect()) == [(1, 3), (1, 5), (2, 3), (2, 5)]


def test_one_list_a_set_writes_no_list_for_an_entity(spark, monkeypatch):
    rng = random.Random(8)
    rows = sorted({(u, rng.randrange(30)) for u in range(12) for _ in range(14)} | {(50, 3)})  # 50 has rows in one fold alone
    folded = spark.createDataFrame([(u, i, rng.randrange(1, 9), (u + i) % 3) for u, i in rows], "entity long, item_id long, score int, fold int")

    def fit(train, by):  # the same lists, as a fit that makes them for every entity
        return tuning.popular_lists(7)(train, by)

    long = {(r["fold"], r["param_id"]): (r["map"], r["mpr"]) for r in tuning.cross_validate(folded, ("occ", "tot"), n=7, fit=fit).collect()}
    monkeypatch.setattr(tuning, "lists_of_sets", None)
    got = {(r["fold"], r["param_id"]): (r["map"], r["mpr"]) for r in tuning.cross_validate(folded, ("occ", "tot"), n=7, fit=tuning.popular_lists(7)).collect()}
    assert set(got) == set(long) and len(got) == 6
    assert all(got[k] == pytest.approx(long[k], abs=1e-12) for k in got)


def test_written_lists_of_sets_are_scored_by_their_hits(spark):
    rng = random.Random(3)
    recs = spark.createDataFrame([(p, e, k + 1, i) for p in (0, 1) for e in range(8) for k, i in enumerate(rng.sample(range(40), 12))],
                                 "param_id int, entity long, rank int, item_id long")
    labels = spark.createDataFrame([(e, rng.randrange(40)) for e in (0, 1, 2, 3, 4, 5, 99) for _ in range(9)], "entity long, item_id long")
    got = {r["param_id"]: r for r in metrics.evaluate_sets(recs, labels, ["param_id"]).collect()}
    for p in (0, 1):
        want = metrics.ranking_metrics(recs.filter(F.col("param_id") == p), labels).first()
        for c in want.asDict():
            assert got[p][c] == pytest.approx(want[c], abs=1e-12)

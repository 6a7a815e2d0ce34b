import numpy as np
import pytest
from pyspark.sql import functions as F

from playlens.operators import metrics, recommend, similarity
from playlens.operators.sparse_product import sparse_product

COS = {(1, 2): 0.729935, (1, 3): 0.472645, (2, 3): 0.188040, (3, 4): 0.850808}


def test_item_cosine_hand_case(T):
    got = {(r["item_i"], r["item_j"]): r["sim"] for r in similarity.item_cosine(similarity.log_weights(T)).collect()}
    for (i, j), v in COS.items():
        assert got[(i, j)] == pytest.approx(v, abs=1e-6)
        assert got[(j, i)] == pytest.approx(v, abs=1e-6)
    assert (1, 4) not in got and (2, 4) not in got
    assert all(0 < v <= 1 + 1e-12 for v in got.values())


def test_knn_score_hand_case(T):
    w = similarity.log_weights(T)
    nb = similarity.k_similar_items(w, 2)
    assert {(r["item_i"], r["item_j"]) for r in nb.filter(F.col("item_i") == 3).collect()} == {(3, 4), (3, 1)}
    pred = {(r["row"], r["item_id"]): r["score"] for r in recommend.predict_knn(w, nb).collect()}
    assert pred[(2, 3)] == pytest.approx(0.604674, abs=1e-6)
    assert (2, 4) not in pred            # zero score is not emitted
    recs = recommend.recommend_knn(w, nb, 5).filter(F.col("row") == 2).collect()
    assert [(r["rank"], r["item_id"]) for r in recs] == [(1, 3)]


def _random_sparse(rng, n_rows, n_keys, density):
    m = (rng.random((n_rows, n_keys)) < density) * rng.random((n_rows, n_keys))
    return m


@pytest.mark.parametrize("general", [False, True])
def test_sparse_product_matches_numpy(spark, general):
    rng = np.random.default_rng(3)
    a = _random_sparse(rng, 40, 30, 0.2)
    b = _random_sparse(rng, 35, 30, 0.2)
    a[:, 0] = rng.random(40) + 0.1      # a "hot" key shared by every row
    b[:, 0] = rng.random(35) + 0.1
    x = spark.createDataFrame([(int(r), int(t), float(a[r, t])) for r, t in zip(*np.nonzero(a))], "r long, t long, x double")
    y = spark.createDataFrame([(int(q), int(t), float(b[q, t])) for q, t in zip(*np.nonzero(b))], "q long, t long, y double")
    kw = dict(chunk_entries=50, heavy_key=10) if general else {}
    dense = a @ b.T
    got = {(r["r"], r["q"]): r["v"] for r in sparse_product(x, y, **kw).collect()}
    for (r, q), v in got.items():
        assert v == pytest.approx(dense[r, q])
    assert len(got) == int((dense != 0).sum())
    top = sparse_product(x, y, k=3, **kw).collect()
    for r in range(40):
        row = dense[r]
        order = sorted(((-round(row[q], 9), q) for q in range(35) if row[q] > 0))[:3]
        assert [(t["q"]) for t in sorted((t for t in top if t["r"] == r), key=lambda t: t["rank"])] == \
               [q for _, q in order]


P_RECS = [(1, [1, 2, 3, 4]), (2, [1, 2]), (3, [5, 6])]
P_LABELS = [(1, [2, 4, 9]), (3, [5])]


def _pairs(spark):
    recs = spark.createDataFrame([(e, k + 1, i) for e, lst in P_RECS for k, i in enumerate(lst)],
                                 "entity long, rank int, item_id long")
    labels = spark.createDataFrame([(e, i) for e, lst in P_LABELS for i in lst], "entity long, item_id long")
    return recs, labels


def test_ranking_metrics_hand_case(spark):
    recs, labels = _pairs(spark)
    m = metrics.ranking_metrics(recs, labels).first()
    assert m["map"] == pytest.approx(0.444444, abs=1e-6)
    assert m["ndcg"] == pytest.approx(0.499396, abs=1e-6)
    assert m["recall"] == pytest.approx(0.833333, abs=1e-6)
    assert m["precision"] == pytest.approx(0.333333, abs=1e-6)
    assert m["f1"] == pytest.approx(0.476190, abs=1e-6)
    assert m["mpr"] == pytest.approx(22.222222, abs=1e-6)


def test_metrics_agree_with_mllib(spark):
    from pyspark.ml.evaluation import RankingEvaluator
    recs, labels = _pairs(spark)
    pl = metrics.prediction_labels(recs, labels).select(
        F.col("recs").cast("array<double>").alias("prediction"), F.col("labels").cast("array<double>").alias("label"))
    ev_map = RankingEvaluator(metricName="meanAveragePrecision").evaluate(pl)
    ev_ndcg = RankingEvaluator(metricName="ndcgAtK", k=10).evaluate(pl)
    m = metrics.ranking_metrics(recs, labels).first()
    assert m["map"] == pytest.approx(ev_map)
    assert m["ndcg"] == pytest.approx(ev_ndcg)


def test_evaluate_at_cuts_lists(spark):
    recs, labels = _pairs(spark)
    rows = {r["n"]: r for r in metrics.evaluate_at(recs, labels, ns=[1, 4]).collect()}
    assert rows[4]["map"] == pytest.approx(0.444444, abs=1e-6)
    assert rows[1]["precision"] == pytest.approx(1 / 3)


def test_evaluate_at_gives_the_metrics_of_cut_lists_in_one_pass(spark):
    rng = np.random.default_rng(8)
    lists = [(e, k + 1, int(i)) for e in range(12) for k, i in enumerate(rng.permutation(30)[:rng.integers(1, 20)])]
    recs = spark.createDataFrame(lists, "entity long, rank int, item_id long")
    given = [(int(e), int(i)) for e in range(3, 15) for i in rng.integers(0, 30, 6)] + [(None, 3)]
    labels = spark.createDataFrame(given, "entity long, item_id long")
    out = metrics.evaluate_at(recs, labels, ns=[2, 11, 25])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    for r in out.collect():
        want = metrics.ranking_metrics(recs.filter(F.col("rank") <= r["n"]), labels).first()
        assert all(r[c] == pytest.approx(want[c], abs=1e-12) for c in metrics.METRIC_COLUMNS), r["n"]


def test_popular_and_random_lists(spark, T):
    from playlens.operators import stats
    ents = spark.createDataFrame([(10,), (11,)], "entity long")
    pop = recommend.recommend_popular(ents, stats.song_play_mean(T), "tot", 2).collect()
    assert sorted((r["entity"], r["rank"], r["item_id"]) for r in pop) == \
        [(10, 1, 1), (10, 2, 3), (11, 1, 1), (11, 2, 3)]
    with pytest.raises(ValueError):
        recommend.top_items(stats.song_play_mean(T), "nope", 2)
    rnd = recommend.recommend_random(ents, stats.song_play_mean(T), 5, 1).collect()
    assert len(rnd) == 2          # 20% of 4 items rounds to 1 item, for each entity


def test_top_n_from_factors_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    u = rng.normal(size=(37, 4))
    v = rng.normal(size=(53, 4))
    uf = spark.createDataFrame([(i, [float(x) for x in u[i]]) for i in range(37)], "id int, features array<float>")
    vf = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(53)], "id int, features array<float>")
    got = recommend.top_n_from_factors(uf, vf, 5, max_cells=200).collect()
    u32 = u.astype(np.float32).astype(np.float64)
    v32 = v.astype(np.float32).astype(np.float64)
    s = u32 @ v32.T
    for r in range(37):
        want = sorted(range(53), key=lambda q: (-s[r, q], q))[:5]
        mine = [t["q"] for t in sorted((t for t in got if t["r"] == r), key=lambda t: t["rank"])]
        assert mine == want


def test_ranks_do_not_depend_on_tiling(spark):
    """Tied and nearly tied products rank alike at every tile and chunk size."""
    from playlens.operators.sparse_product import sparse_product
    x = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5), (2, 2, 0.5)], "r long, t long, x double")
    near = [0.1234567885, 0.123456788, 0.123456789, 0.1234567895, 0.5, 0.5]
    y = spark.createDataFrame([(i + 1, t, v) for i, v in enumerate(near) for t in (1, 2)], "q long, t long, y double")
    lists = []
    for kw in ({}, {"chunk_entries": 2}, {"chunk_entries": 5}, {"chunk_entries": 4, "heavy_key": 2}):
        lists.append(sorted((r["r"], r["rank"], r["q"]) for r in sparse_product(x, y, k=4, **kw).collect()))
    assert all(found == lists[0] for found in lists[1:])

"""Cross-validation takes every play and every parameter set."""

import itertools

from playlens.plans import queries as q
from tests.conftest import SF_SMALL


def test_folds_hold_the_virtual_users_of_all_plays(spark):
    q._LOCAL.memo = {}
    folded = q._cv_folded(spark, SF_SMALL)
    cells = q._plays(spark, SF_SMALL).join(q._membership(spark, SF_SMALL), "user_id").select("group_id", "item_id").distinct()
    assert folded.count() == cells.count() > q._virtual(spark, SF_SMALL, "train").count()
    assert folded.select("entity", "item_id").exceptAll(cells).count() == 0


def test_grid_is_every_rank_lambda_and_alpha():
    ranks, lambdas, alphas = ({g[k] for g in q.CV_GRID} for k in range(3))
    assert min(map(len, (ranks, lambdas, alphas))) > 1
    assert sorted(q.CV_GRID) == sorted(itertools.product(ranks, lambdas, alphas))


def test_grid_is_an_argument(spark):
    q._LOCAL.memo = {}
    rows = q._cv_scores(spark, SF_SMALL, ((5, 0.1, 0.01), (5, 1.0, 0.1))).collect()
    assert sorted((r["fold"], r["param_id"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_songs_are_summed_once_for_all_folds(spark):
    from pyspark.sql import functions as F

    from playlens.operators import tuning
    rows = [(e, (e * 7 + i * i) % 9 if i % 4 else None, 1 + (e + i) % 5, (e + i) % 3 if i % 5 else None) for e in range(10) for i in range(12)]
    stored = spark.createDataFrame(rows, "entity long, item_id long, score int, fold int")
    fit = tuning.popular_lists(5)
    every = fit.fold_statistics(stored, [0, 1, 2])
    for k in range(3):
        want = fit.statistics(stored.filter(F.col("fold") != k)).collect()
        got = every.filter(F.col(f"occurrence_{k}") > 0).select("id", f"total_{k}", f"occurrence_{k}").collect()
        assert sorted(tuple(r) for r in got) == sorted((r["id"], r["total_play"], r["occurrence"]) for r in want)

"""ALS fits of a grid as tasks of one job: MLlib's models and lists, however they are batched."""

import random

import numpy as np
import pytest

from playlens.operators import als_grid, tuning

GRID = ((3, 0.1, 1.0), (8, 0.01, 10.0), (8, 100.0, 0.01), (40, 1.0, 0.1))


def _folded(spark):
    rng = random.Random(5)
    cells = sorted({(u, rng.randrange(60)) for u in range(25) for _ in range(30 if u else 59)})
    rows = [(u, i * 7, float(rng.randrange(0, 9)), rng.randrange(2)) for u, i in cells] + [(77, 3, 2.0, 1), (3, None, None, 0)]
    return spark.createDataFrame(rows, "entity long, item_id long, score double, fold int").filter("item_id is not null")


def test_grid_scores_are_those_of_mllib_fits(spark, monkeypatch):
    folded = _folded(spark)
    train, labels = folded.filter("fold = 0"), folded.filter("fold = 1").select("entity", "item_id")
    with monkeypatch.context() as m:
        m.setattr(tuning, "fits_one_task", lambda *a: False)
        want = tuning.cross_validate(folded, GRID, n=12, cv=2).collect()
        want_scan = tuning.grid_scan(train, labels, GRID, 12).collect()
    monkeypatch.setattr(tuning, "lists_of_sets", None)  # no fit for each set
    got = {(r["fold"], r["param_id"]): r for r in tuning.cross_validate(folded, GRID, n=12, cv=2).collect()}
    assert len(got) == len(want) == 2 * len(GRID)
    for r in want:
        assert tuple(got[r["fold"], r["param_id"]]) == pytest.approx(tuple(r), abs=1e-9)
    scan = {r["param_id"]: r for r in tuning.grid_scan(train, labels, GRID, 12).collect()}
    for r in want_scan:
        assert tuple(scan[r["param_id"]]) == pytest.approx(tuple(r), abs=1e-9)


@pytest.mark.parametrize("batch", [16, 1 << 21])
def test_a_side_is_solved_exactly(monkeypatch, batch):
    monkeypatch.setattr(als_grid, "_BATCH", batch)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 5, 6, 7, 30, 30]  # below and above the rank
    at = np.repeat(np.arange(len(sizes)), sizes)
    idx, val = rng.integers(0, 40, len(at)), rng.integers(-2, 9, len(at)).astype(np.float32)
    val[np.r_[0, np.cumsum(sizes)[:-1]]] = 3.0  # a positive one each
    other = rng.normal(size=(40, 6)).astype(np.float32)
    got = als_grid.solve_side(other, als_grid.Side.of(at, idx, val, len(sizes)), 0.1, 2.0)
    y = other.astype(float)
    for j in range(len(sizes)):
        r, f = val[at == j].astype(float), y[idx[at == j]]
        c = 2.0 * np.abs(r)
        a = y.T @ y + (f * c[:, None]).T @ f + 0.1 * (r > 0).sum() * np.eye(6)
        assert got[j] == pytest.approx(np.linalg.solve(a, f.T @ np.where(r > 0, 1 + c, 0.0)), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 0.0])
def test_best_items_with_ties(monkeypatch, scale):
    monkeypatch.setattr(als_grid, "_USERS", 7)
    monkeypatch.setattr(als_grid, "_ITEMS", 50)
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(20, 5)).astype(np.float32), (scale * rng.normal(size=(330, 5))).astype(np.float32)
    u[::4], v[::2] = 0, v[0]
    keys = np.rint(u.astype(float) @ v.astype(float).T * 1e9)
    for n in (3, 60, 400):
        got = np.concatenate([np.c_[x] for x in als_grid.best_items(u, v, n)])
        for k in range(20):
            mine = got[got[:, 0] == k]
            assert mine[np.argsort(mine[:, 2]), 1].tolist() == np.lexsort((np.arange(330), -keys[k]))[:n].tolist()

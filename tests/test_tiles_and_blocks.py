"""Tiles of the sparse product and blocks of large users: same results at every size,
copies that follow the tile's side, no join on a frequent key."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playlens.operators import preference
from playlens.operators.sparse_product import (_row_block, read_lists, row_block_entries, sparse_product, tile_counts,
                                               tile_entries, write_lists)


def _entries(seed=3, rows=60, keys=40):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((rows, keys)) < 0.2, rng.integers(1, 6, (rows, keys)), 0).astype(float)
    m[:, 0] = 1.0  # a key that all rows share
    return m


def _tables(spark, m):
    at = [(int(i), int(t), float(m[i, t])) for i, t in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(at, "r long, t long, x double"), spark.createDataFrame(at, "q long, t long, y double")


@pytest.mark.parametrize("exclude", [None, "self", "x_support"])
def test_square_tiles_give_the_same_lists(spark, exclude):
    m = _entries()
    x, y = _tables(spark, m)
    full = m @ m.T
    if exclude == "self":
        np.fill_diagonal(full, 0)
    elif exclude == "x_support":
        full[:, :40][m > 0] = 0
    want = []
    for r in range(len(m)):
        order = np.lexsort((np.arange(len(m)), -full[r]))[:5]
        want += [(r, k + 1, int(q), float(full[r, q])) for k, q in enumerate(order) if full[r, q] > 0]
    for kw in ({}, {"max_cells": 40}, {"max_cells": 40, "heavy_key": 50}, {"max_cells": 40, "heavy_key": 50, "chunk_entries": 100}):
        got = sorted((r["r"], r["rank"], r["q"], r["v"]) for r in sparse_product(x, y, k=5, exclude=exclude, **kw).collect())
        assert got == want, kw


def test_all_cells_of_square_tiles(spark):
    m = _entries(seed=5)
    x, y = _tables(spark, m)
    full = m @ m.T
    for kw in ({"max_cells": 20}, {"max_cells": 20, "heavy_key": 30, "chunk_entries": 150}):
        got = {(r["r"], r["q"]): r["v"] for r in sparse_product(x, y, **kw).collect()}
        assert got == {(int(i), int(j)): full[i, j] for i, j in zip(*np.nonzero(full), strict=True)}


def test_copies_follow_the_side():
    cells = 1 << 24
    side = int((cells * 8) ** 0.5)
    for n in (side * 4, side * 64):
        rows, cols, _ = tile_counts(n, n, 10 ** 12, cells, 4_000_000, 8)
        assert rows <= n // side + 1 and cols <= n // side + 1  # a block row for each would be n / 8 x as many
    assert tile_counts(1000, 500, 10, cells, 4_000_000, 8) == (8, 1, 1)
    assert tile_counts(3, 5, 10, cells, 4_000_000, 8) == (3, 1, 1)


def test_heavy_keys_are_not_joined(spark):
    m = _entries()
    x, y = _tables(spark, m)
    xs = x.select(F.col("r").alias("a"), "t", F.col("x").alias("v"))
    ys = y.select(F.col("q").alias("a"), "t", F.col("y").alias("v"))
    joined = tile_entries(xs, ys, 6, 5, 1, 10 ** 9, 0)
    spread = tile_entries(xs, ys, 6, 5, 1, 50, 10 ** 6)

    def copies(df, key):
        return sorted(tuple(r) for r in df.where(F.col("t") == key).select("I", "J", "side", "a").collect())

    # key 0 (120 entries) is used by every block: the same copies, made without a join on it
    assert copies(joined, 0) == copies(spread, 0) and len(copies(spread, 0)) == 60 * 5 + 60 * 6
    assert copies(joined, 7) == copies(spread, 7)


@pytest.mark.parametrize("block_songs", [100_000, 50, 7])
def test_user_similarity_in_blocks_of_a_large_user(spark, block_songs):
    rng = np.random.default_rng(11)
    v = np.zeros((12, 300))
    v[0] = rng.normal(size=300)  # more than a third of all rows
    for u in range(1, 12):
        at = rng.choice(300, 20, replace=False)
        v[u, at] = rng.normal(size=20)
    rows = [(int(u), int(i), float(v[u, i])) for u, i in zip(*np.nonzero(v), strict=True)]
    centred = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    ids = [(a, b) for a in range(12) for b in range(12) if a != b]
    pairs = spark.createDataFrame(ids, "user_u long, user_v long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["user_u"], r["user_v"]): r["similarity"]
               for r in preference.user_similarity(centred, pairs, block_songs=block_songs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    n = np.sqrt((v * v).sum(axis=1))
    assert set(got) == set(ids)
    assert all(abs(got[a, b] - v[a] @ v[b] / (n[a] * n[b])) < 1e-12 for a, b in ids)


@pytest.mark.parametrize("exclude", [None, "self", "x_support"])
@pytest.mark.parametrize("top", [None, 5])
def test_row_blocks_give_the_cells_of_tiles(spark, exclude, top):
    if top is None and exclude:
        pytest.skip("all cells are asked for without exclusion")
    m = _entries(seed=9)
    x, y = _tables(spark, m)

    def rows(**kw):
        out = sparse_product(x, y, k=top, exclude=exclude, max_cells=40, **kw)
        return sorted(tuple(r[c] for c in ("r", "q", "v", *(("rank",) if top else ()))) for r in out.collect())

    assert rows(row_entries=150) == rows(row_entries=0) != []  # 0: no number of blocks fits, tiles are left


def test_row_blocks_take_a_key_once_for_each_block(spark):
    m = _entries()
    x, y = _tables(spark, m)
    xs = x.select(F.col("r").alias("a"), "t", F.col("x").alias("v"))
    ys = y.select(F.col("q").alias("a"), "t", F.col("y").alias("v"))
    for size in (4096, 7, 2):  # one list a key, some, and more than are joined
        rows = row_block_entries(xs, ys, 6, size).collect()
        assert sorted((r["a"], r["t"], r["v"]) for r in rows if r["qs"] is None) == sorted(tuple(r) for r in xs.collect())
        used = {(r["I"], r["t"]) for r in rows if r["qs"] is None}
        got = {}
        for r in rows:
            if r["qs"] is not None:
                got.setdefault((r["I"], r["t"]), []).extend(zip(r["qs"], r["ys"], strict=True))
        assert used <= set(got) and (size < 4096 or used == set(got))
        for (_, t), have in got.items():
            assert sorted(have) == [(q, m[q, t]) for q in range(len(m)) if m[q, t]]


def test_a_row_of_very_many_products_is_summed_in_steps():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (5, 30)).astype(float)
    for far in (1, 1 << 45):  # ids close together, and far apart
        at = [(int(r), int(t)) for r, t in zip(*np.nonzero(m), strict=True)]
        lists = [[int(q) for q in range(5) if m[q, t]] for t in range(30)]
        own = pa.RecordBatch.from_pydict({"t": [t for _, t in at], "a": [r * far for r, _ in at], "v": [m[r, t] for r, t in at],
                                          "qs": pa.nulls(len(at), pa.list_(pa.int64())), "ys": pa.nulls(len(at), pa.list_(pa.float64()))})
        packed = pa.RecordBatch.from_pydict({"t": list(range(30)), "a": pa.nulls(30, pa.int64()), "v": pa.nulls(30, pa.float64()),
                                             "qs": pa.array([[q * far for q in ids] for ids in lists], pa.list_(pa.int64())),
                                             "ys": pa.array([[m[q, t] for q in ids] for t, ids in enumerate(lists)], pa.list_(pa.float64()))})
        full = m @ m.T
        for step in (1, 7, 40, 10 ** 6):
            got = {(r, q): v for b in _row_block(iter([own, packed]), None, None, step) for r, q, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
            assert got == {(r * far, q * far): full[r, q] for r in range(5) for q in range(5) if full[r, q]}


@pytest.mark.parametrize("exclude", [None, "self", "x_support"])
@pytest.mark.parametrize("top", [None, 5])
def test_stored_lists_give_the_cells_of_copied_ones(spark, exclude, top):
    m = _entries(seed=9)
    x, y = _tables(spark, m)
    full = m @ m.T
    if exclude == "self":
        np.fill_diagonal(full, 0)
    elif exclude == "x_support":
        full[:, :40][m > 0] = 0

    def rows(y, **kw):
        out = sparse_product(x, y, k=top, exclude=exclude, max_cells=40, **kw)
        return sorted(tuple(r[c] for c in ("r", "q", "v", *(("rank",) if top else ()))) for r in out.collect())

    stored = rows(y, row_entries=150, copies=0)
    assert stored == rows(None, row_entries=150, copies=0) == rows(y, row_entries=150, copies=10 ** 9) == rows(y, row_entries=0) != []
    if top is None:
        assert stored == [(int(i), int(j), full[i, j]) for i, j in zip(*np.nonzero(full), strict=True)]


@pytest.mark.parametrize("size, entries", [(4096, 1 << 20), (7, 50), (2, 20), (4096, 5)])
def test_lists_are_written_once_and_read_by_key(spark, size, entries):
    m = _entries()
    _, y = _tables(spark, m)
    ys = y.select(F.col("q").alias("a"), "t", F.col("y").alias("v"))
    folder, shards = write_lists(ys, ys.count(), size, entries)
    for keys in (np.arange(40), np.array([0, 7, 39]), np.array([-5, 100])):
        got = {}
        for b in read_lists(folder, shards, keys):
            for t, qs, vs in zip(*(b.column(c).to_pylist() for c in ("t", "qs", "ys")), strict=True):
                got.setdefault(t, []).extend(zip(qs, vs, strict=True))
        want = {int(t): [(q, m[q, t]) for q in range(len(m)) if m[q, t]] for t in keys if 0 <= t < 40}
        assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}

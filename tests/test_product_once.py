"""The kNN product is made once, its entries are not shuffled to be cut into lists, and what
its lists replace is not kept."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from playlens.operators import recommend, similarity
from playlens.operators.sparse_product import _pieces, sparse_product
from playlens.plans import queries
from playlens.session import ensure_checkpoint_dir
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scaled_neighbours_make_their_product_once(spark, T):
    scaled = recommend._scaled_neighbours(similarity.k_similar_items(similarity.log_weights(T), 2))
    assert _plan(scaled).count("FlatMapGroupsIn") == 1


def test_scaled_neighbours_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(5), rng.choice([None, 0.0, 0.25, 0.5])) for _ in range(40)] + [(9, 1, 0.0), (9, 2, None)]
    rows += rows[:10]  # repeated rows count each time
    got = recommend._scaled_neighbours(spark.createDataFrame(rows, "item_i long, item_j long, sim double")).collect()
    den = {i: sum(s or 0.0 for a, _, s in rows if a == i) for i in (1, 2, 3)}
    want = [(i, j, None if s is None else s / den[i]) for i, j, s in rows if i in den]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_pieces_shuffle_no_entries(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large input
    try:
        ys = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 7 % 3).alias("t"), F.lit(1.0).alias("v"))
        cut = _pieces(ys, 30)
        assert "BroadcastHashJoin" in cut._jdf.queryExecution().sparkPlan().toString()
        rows = cut.collect()
        sizes = {t: sum(r["t"] == t for r in rows) for t in range(3)}
        assert len(rows) == 100 and all(r["k"] == max(1, -(-sizes[r["t"]] // 30)) and 0 <= r["piece"] < r["k"] for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_knn_weights_are_kept_by_columns(spark):
    queries._LOCAL.memo = {}
    try:
        files = queries._knn_weights(spark, SF_SMALL).inputFiles()
    finally:
        queries._LOCAL.memo = {}
    assert files and all("knn-weights" in f and f.endswith(".parquet") for f in files)


@pytest.mark.parametrize("copies", [0.0, 1e9])
def test_the_table_of_stored_lists_is_dropped(spark, copies):
    rng = random.Random(8)
    x = [(r, t, rng.random()) for r in range(30) for t in rng.sample(range(20), 6)]
    y = [(q, t, rng.random()) for q in range(25) for t in rng.sample(range(20), 5)]
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/scratch-product-y-*"))
    out = sparse_product(spark.createDataFrame(x, "r long, t long, x double"), spark.createDataFrame(y, "q long, t long, y double"),
                         chunk_entries=20, row_entries=1000, copies=copies)
    kept = set(glob.glob(f"{root}/scratch-product-y-*")) - before
    assert len(kept) == (0 if copies == 0.0 else 1)
    want = {}
    for r, t, a in x:
        for q, s, b in y:
            if s == t:
                want[r, q] = want.get((r, q), 0.0) + a * b
    got = {(r["r"], r["q"]): r["v"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - v) < 1e-9 for c, v in want.items())

"""As-of slices, the field registry, two-level ranks, factor tiles and bounded arrays."""

import hashlib
import random
from bisect import bisect_right

import pandas as pd
import pytest
from pyspark.sql import functions as F

from playlens.functions import numbering
from playlens.operators import catalogue, metrics, recommend
from playlens.sources import fixtures as fx
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("span", [2, 7, 1 << 16])
def test_owner_of_against_brute_force(spark, span):
    """Empty songs, gaps, values before the first start, a song with most of the values."""
    rng = random.Random(4)
    starts, values = [], []
    for field in "ab":
        at, cuts = 5, []
        for song in range(0, 40, 2):
            cuts.append(at)
            starts.append((field, at, song))
            at += 400 if song == 20 else rng.choice([0, 0, 1, 3])
        values += [(field, p, float(p)) for p in range(at + 3) if rng.random() < 0.9]
    found = catalogue.owner_of(spark.createDataFrame(starts, "field string, pos long, song_idx long"),
                               spark.createDataFrame(values, "field string, pos long, value double"), ["field"], span)
    want = set()
    for field, p, v in values:
        own = sorted((s, song) for f, s, song in starts if f == field)
        k = bisect_right([s for s, _ in own], p)
        if k:
            want.add((field, p, own[k - 1][1], own[k - 1][0], v))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_every_getter_has_a_field(spark):
    scalars = [n for n, f in catalogue.FIELDS.items() if f.offset is None]
    arrays = [n for n, f in catalogue.FIELDS.items() if f.offset]
    assert len(catalogue.FIELDS) == 54 and len(scalars) == 33 and len(arrays) == 21
    assert set(scalars) == set(fx.SCALARS) and {f.offset for f in catalogue.FIELDS.values() if f.offset} == set(fx.OFFSETS)
    assert {catalogue.FIELDS[n].group for n in ("artist_mbtags", "artist_mbtags_count")} == {"musicbrainz"}
    groups = fx.catalogue_groups(spark, SF_SMALL)
    plan = catalogue.scalar_fields(groups, ["tempo"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan and "Join" not in plan
    for call in (lambda: catalogue.scalar_fields(groups, ["beats_start"]), lambda: catalogue.scalar_fields(groups, ["x"]),
                 lambda: catalogue.array_fields(groups, spark.range(1), ["tempo"])):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("most,head", [(10, 1), (10, 3), (1000, 3)])
def test_ranks_of_hot_and_plain_groups(spark, monkeypatch, most, head):
    monkeypatch.setattr(numbering, "HEAD_DIGITS", head)
    rows = [(u, i, hashlib.md5(f"{u}:{i}".encode()).hexdigest()) for u, n in ((1, 700), (2, 3), (3, 60), (None, 40), (4, 1)) for i in range(n)]
    out = numbering.rank_within(spark.createDataFrame(rows, "u long, i long, k string"), ["u"], "k", ["i"], max_window_rows=most)
    assert out.columns == ["u", "i", "k", "rank", "group_size"]
    got = {(r["u"], r["i"]): (r["rank"], r["group_size"]) for r in out.collect()}
    for u in {r[0] for r in rows}:
        mine = sorted((k, i) for v, i, k in rows if v == u)
        assert [got[u, i] for _, i in mine] == [(r + 1, len(mine)) for r in range(len(mine))]


@pytest.mark.parametrize("cells", [1 << 24, 4096, 500, 7])
def test_factor_lists_at_every_tile_size(spark, cells):
    rng = random.Random(1)
    make = lambda n: spark.createDataFrame([(i, [round(rng.uniform(-1, 1), 2) for _ in range(4)]) for i in range(n)], "id long, features array<float>")
    users, items = make(30), make(50)
    u, v = users.collect(), items.collect()
    want = {}
    for a in u:
        s = sorted(((-round(sum(x * y for x, y in zip(a["features"], b["features"], strict=True)), 9), b["id"]) for b in v))
        want[a["id"]] = [i for _, i in s[:6]]
    got = {}
    for r in recommend.top_n_from_factors(users, items, 6, max_cells=cells).orderBy("r", "rank").collect():
        got.setdefault(r["r"], []).append(r["q"])
    assert got == want


@pytest.mark.parametrize("n,top", [(3, 3), (7, 7)])
def test_factor_lists_with_ties_negatives_and_zero_rows(spark, n, top):
    """Equal norms, equal scores, users whose best scores are below zero, zero factors."""
    vectors = [(i, [float(i % 3), -1.0 if i % 2 else 1.0]) for i in range(40)] + [(40, [0.0, 0.0])]
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.3, -2.0])], "id long, features array<float>")
    items = spark.createDataFrame(vectors, "id long, features array<float>")
    want = {}
    for u in users.collect():
        scored = sorted((-round(sum(x * y for x, y in zip(u["features"], v, strict=True)), 9), i) for i, v in vectors)
        want[u["id"]] = [i for _, i in scored[:top]]
    for cells in (1 << 24, 300, 64, 9):
        rows = recommend.top_n_from_factors(users, items, n, max_cells=cells).orderBy("r", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["r"], []).append(r["q"])
        assert got == want, cells


def test_blocks_under_the_bound_are_left_out(spark):
    users = spark.createDataFrame([(1, 1.0, [1.0]), (2, 1.0, [1.0]), (3, 10.0, [10.0]), (4, 1.0, [1.0])], "a long, norm double, features array<double>")
    first = spark.createDataFrame([(1, 9.0, 1), (1, 8.0, 2), (2, 9.0, 1), (2, 4.0, 2), (3, 90.0, 1), (3, 1.0, 2), (4, 9.0, 1)], "r long, v double, rank int")
    norms = [9.0, 7.0, 5.0, 4.0, 2.0, 1.0]
    need = {r["a"]: r["need"] for r in recommend.blocks_needed(users, first, norms, 2).collect()}
    assert need == {1: 0, 2: 3, 3: 5, 4: 5}  # 4 equals the bound of the third, a short list needs all


def test_bounds_in_steps_leave_out_no_block_that_is_needed(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BOUND_STEPS", 2)
    users = spark.createDataFrame([(i, 1.0, [1.0]) for i in range(8)], "a long, norm double, features array<double>")
    first = spark.createDataFrame([(i, float(i), 1) for i in range(8)], "r long, v double, rank int")
    norms = [9.0, 6.5, 5.5, 4.5, 3.5, 2.5]
    need = {r["a"]: r["need"] for r in recommend.blocks_needed(users, first, norms, 1).collect()}
    assert all(need[i] >= sum(b >= i for b in norms[1:]) for i in range(8)) and need[7] == 0 and need[4] == 3


def test_label_blocks_hold_every_label(spark):
    labels = spark.createDataFrame([(1, i) for i in range(0, 50, 2)] + [(2, 7), (2, 7)], "entity long, item_id long")
    index = spark.createDataFrame([(i, i) for i in range(60)], "id long, idx int")
    rows = metrics.label_blocks(labels, index, 8).collect()
    assert max(len(r["items"]) for r in rows) <= 8 and all(r["n"] == len(r["items"]) for r in rows)
    lists = {e: [i for r in sorted((r for r in rows if r["entity"] == e), key=lambda r: r["block"]) for i in r["items"]] for e in (1, 2)}
    assert lists == {1: list(range(0, 50, 2)), 2: [7]}


def test_tiles_hand_on_nothing_under_the_known_scores(monkeypatch):
    monkeypatch.setattr(recommend, "PASS_CELLS", 10)
    vectors = [(0, 1, [1.0], 3.0), (0, 2, [2.0], float("nan")), (0, 3, [1.0], 9.5)] + [(1, i, [float(i)], float("nan")) for i in range(6)]
    tile = pd.DataFrame(vectors, columns=["side", "a", "features", "nth"])
    out = recommend._tile_top_n(tile, 4)
    assert out.values.tolist() == [[1, 5, 5], [1, 4, 4], [1, 3, 3], [2, 5, 10], [2, 4, 8], [2, 3, 6], [2, 2, 4]]


def test_als_has_no_more_blocks_than_cores_until_they_are_large(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK_RATINGS", 10)
    monkeypatch.setattr(recommend, "MOST_BLOCK_RATINGS", 1000)
    cores = spark.sparkContext.defaultParallelism
    assert [recommend.als_blocks(spark.range(n)) for n in (5, 25, 9000, 900 * cores, 2000 * cores)] == [1, 3, max(9, cores), cores, 2 * cores]

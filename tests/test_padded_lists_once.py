"""Full kNN lists: the product behind them is made once, and only the items that can fill a
list are placed; the sweep reads written lists."""

import random

import pytest

from playlens.operators import metrics, recommend, similarity


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_padding_makes_the_product_once(spark, T):
    w = similarity.log_weights(T)
    full = recommend.recommend_knn(w, similarity.k_similar_items(w, 2), 3, pad=True)
    assert "FlatMapGroupsIn" not in _plan(full)  # the lists are read, not made again


def test_sweep_reads_written_lists(spark):
    rows = spark.range(40).selectExpr("id % 4 entity", "cast(id div 4 + 1 as int) rank", "id * 3 % 41 item_id").mapInPandas(
        lambda parts: parts, "entity long, rank int, item_id long")
    labels = spark.createDataFrame([(e, i) for e in (0, 1, 2, 9) for i in range(e, 41, 5)], "entity long, item_id long")
    got = metrics.evaluate_at(rows, labels, (3, 10))
    assert "MapInPandas" not in _plan(got)
    for r in got.collect():
        want = metrics.ranking_metrics(rows.filter(f"rank <= {r['n']}"), labels).first()
        assert all(r[c] == pytest.approx(want[c], abs=1e-12) for c in want.asDict())


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_few_items_are_placed_and_lists_stay_whole(spark, monkeypatch, sent):
    monkeypatch.setattr(recommend, "PAD_SENT", sent)
    rng = random.Random(9)
    items = rng.sample(range(10000), 3000)
    first = sorted(items)
    played = {(r, i) for r in range(6) for i in rng.sample(items, 3)} | {(6, i) for i in first[:25]} | {(7, i) for i in first[1:12:2]}
    listed = {r: [i for i in rng.sample(first[:30], 4) if (r, i) not in played] for r in range(0, 8, 2)}
    lists = spark.createDataFrame([(r, k + 1, i, 1.0) for r, x in listed.items() for k, i in enumerate(x)], "row long, rank int, item_id long, score double")
    out = recommend.pad_lists(lists, spark.createDataFrame(sorted(played) * 2, "row long, item_id long"),
                              spark.createDataFrame([(i,) for i in items], "item_id long"), 12)
    rows = out.collect()
    for r in range(8):
        free = [i for i in first if (r, i) not in played and i not in listed.get(r, [])]
        assert [x["item_id"] for x in sorted((x for x in rows if x["row"] == r), key=lambda x: x["rank"])] == (listed.get(r, []) + free)[:12]
    most = max(2 * sum(q == r for q, _ in played) + len(listed.get(r, [])) for r in range(8))
    assert f"< {12 + most})" in _plan(out)  # items at positions below n + the most taken

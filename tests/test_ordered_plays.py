"""Plays dealt by ranges of (user, item): the same sums, a user in few tasks, also where ids
are null or repeat and one user has most rows."""

from pyspark.sql import functions as F

from playlens.plans.queries import _write_dataset
from playlens.sources import fixtures as fx
from playlens.sources import text


def _tables(spark, folder):
    orders = [(o, None if o % 50 == 0 else 7 if o % 3 == 0 else o % 40) for o in range(400)] + [(None, 1), (8, 9)]
    lines = [(o, None if o % 31 == 0 else (o * k) % 60, None if k == 4 and o % 9 == 0 else float(k)) for o in range(400) for k in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").repartition(4).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").repartition(4).write.parquet(f"{folder}/lineitem.parquet")


def test_ordered_plays_have_the_same_rows(spark, tmp_path):
    _tables(spark, str(tmp_path))
    plain, ordered = fx.plays(spark, str(tmp_path)), fx.plays(spark, str(tmp_path), ordered=True)
    assert sorted(map(str, ordered.collect())) == sorted(map(str, plain.collect()))
    assert ordered.schema == plain.schema


def test_a_task_holds_a_range_of_pairs_in_order(spark, tmp_path):
    _tables(spark, str(tmp_path))
    rows = fx.plays(spark, str(tmp_path), ordered=True).withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r["task"], []).append(tuple((x is not None, x or 0) for x in (r["user_id"], r["item_id"])))
    ends = []
    for pairs in tasks.values():
        assert pairs == sorted(pairs) and len(set(pairs)) == len(pairs)
        ends.append((pairs[0], pairs[-1]))
    ends.sort()
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_dataset_of_ordered_plays_reads_back(spark, tmp_path):
    _tables(spark, str(tmp_path))
    ordered = fx.plays(spark, str(tmp_path), ordered=True).dropna()
    folder = str(tmp_path / "dataset")
    _write_dataset(spark, str(tmp_path), ordered, folder)
    plays, users, songs = text.load_dataset(spark, folder)
    assert sorted(map(tuple, plays.collect())) == sorted((str(r[0]), str(r[1]), r[2]) for r in fx.plays(spark, str(tmp_path)).dropna().collect())
    assert users.count() == ordered.select("user_id").distinct().count()
    assert songs.count() == ordered.select("item_id").distinct().count()

"""Nearest neighbours against brute force, and the pipeline end to end."""

import numpy as np
from pyspark.sql import functions as F

from playlens.llm import ann

SMALL = "/root/testdata/sf0.001"


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).round(3)
    x[700:1100] = x[700]  # one vector many times: ties to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, x[0].tolist()), (2200, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for q, r, i, s in ann.search(table, F.col("vec_id") % 50 == 0, spec=ann.AnnSpec(part_rows=200)).collect():
        got.setdefault(q, []).append((r, i, s))
    assert set(got) == set(range(0, 1500, 50))  # no vector of its own length but 2200's own
    norm = np.sqrt((x * x).sum(axis=1))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - v) < 1e-12 for _, i, v in found)
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
        if 700 <= q < 1100:
            assert [i for _, i, _ in found] == best.tolist()
    assert hits >= 0.9 * 5 * len(got)
    assert ann.search(table.limit(0), F.lit(True)).count() == 0


def test_blocks_of_queries_change_nothing(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 8)).round(2)
    x[100:300] = x[100]  # a cell with many queries
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [sorted(map(tuple, ann.search(table, F.col("vec_id") % 2 == 0, spec=ann.AnnSpec(part_rows=150, query_rows=n)).collect()))
           for n in (4096, 9)]
    assert got[0] == got[1] and len(got[0]) == 300 * 5


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "mix"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    cur = docs
    from playlens.llm.common import stored
    for name, stage in p.STAGES:
        cur = stored(stage(spark, cur, SMALL), f"test-{name}")
        sizes.append(cur.count())
        if name != "mix":
            assert cur.columns == docs.columns
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0
    again = {r["doc_id"] for r in p.run(spark, SMALL).collect()}
    assert again == {r["doc_id"] for r in cur.collect()}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names

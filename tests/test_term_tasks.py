"""Words of documents are counted and gathered by tasks that follow the size of the table."""

import pytest

from playlens.operators import catalogue
from playlens.sources import fixtures as fx


@pytest.fixture()
def docs(spark, tmp_path):
    rows = [(d, " ".join(f"w{(d * i) % 17} W{i % 5}" for i in range(40)) if d % 7 else None) for d in range(300)] + [(1, "again w1"), (None, "w1 w2")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _terms(spark, docs):
    return sorted(map(str, fx.document_terms(spark, docs).collect()))


def test_tasks_follow_the_size(spark, docs, monkeypatch):
    want = _terms(spark, docs)
    assert fx.document_terms(spark, docs).rdd.getNumPartitions() == 8  # the session's, not merged
    monkeypatch.setattr(fx, "TERM_BYTES", 200)
    assert fx.document_terms(spark, docs).rdd.getNumPartitions() > 20
    assert _terms(spark, docs) == want and len(want) > 1000


def test_records_are_joined_where_their_terms_lie(spark, docs, monkeypatch):
    monkeypatch.setattr(fx, "TERM_BYTES", 200)
    similar = spark.createDataFrame([(d, 0, "a") for d in range(290, 310)], "track_id long, pos long, artist string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = catalogue.track_records(fx.document_terms(spark, docs), similar)
        assert records.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

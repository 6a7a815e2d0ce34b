import pytest
from pyspark.sql import functions as F

from playlens.operators import catalogue, stats
from playlens.session import scratch_path
from playlens.sources import text
from tests.conftest import rows_of


def _write_lines(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    return path


def test_triplet_text_scan(spark):
    path = _write_lines(spark, ["u1 s1 5", "u2\ts2\t7 extra fields", "", "u3,s3,2"])
    got = rows_of(text.read_triplets_text(spark, path), "user_id", "item_id", "play_count")
    assert got == [("u1", "s1", 5), ("u2", "s2", 7), ("u3", "s3", 2)]


def test_triplet_text_scan_bad_count(spark):
    path = _write_lines(spark, ["u1 s1 x"])
    with pytest.raises(Exception):
        text.read_triplets_text(spark, path).collect()
    assert text.read_triplets_text(spark, path, strict=False).first()["play_count"] is None


def test_id_list_trimmed(spark):
    path = _write_lines(spark, ["  a ", "b", "", "c  "])
    assert rows_of(text.read_id_list(spark, path), "id") == [("a",), ("b",), ("c",)]


def test_stats_round_trip(spark, T):
    path = scratch_path(spark, "stats")
    text.write_stats(stats.song_play_mean(T), path)
    back = rows_of(text.read_stats_text(spark, path), "id", "total_play", "occurrence", "mean")
    assert back == [("1", 14, 2, 7.0), ("2", 6, 2, 3.0), ("3", 14, 2, 7.0), ("4", 4, 1, 4.0)]


def test_group_store_prunes_by_size(spark):
    path = scratch_path(spark, "store")
    rows = spark.createDataFrame([(0, "train", 1, 1, 3), (0, "test", 2, 2, 4)],
                                 "group_id BIGINT, split STRING, user_id BIGINT, item_id BIGINT, play_count INT")
    text.save_groups(rows, path, 4)
    text.save_groups(rows.withColumn("play_count", F.lit(9)), path, 12)
    back = text.load_groups(spark, path, 12)
    assert sorted(r["play_count"] for r in back.collect()) == [9, 9]
    assert "PartitionFilters: [isnotnull(group_size" in back._jdf.queryExecution().executedPlan().toString()


def test_ragged_slice_bounds(spark):
    flat = spark.createDataFrame([(i, float(i) * 10) for i in range(6)], "pos BIGINT, value DOUBLE")
    offs = spark.createDataFrame([(0, 0), (1, 3), (2, 3)], "song_idx BIGINT, idx BIGINT")
    got = {r["song_idx"]: r["values"] for r in catalogue.ragged_slice(offs, flat).collect()}
    assert got == {0: [0.0, 10.0, 20.0], 2: [30.0, 40.0, 50.0]}   # song 1 is empty


def test_song_lookups(spark):
    songs = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "song_idx INT, song_id STRING")
    ids = spark.createDataFrame([("A",), ("A",), ("C",)], "song_id STRING")
    assert rows_of(catalogue.song_idx_lookup(songs, ids), "song_id", "song_idx") == [("A", 2)]
    ids = spark.createDataFrame([("A",), ("Z",), ("Z",)], "song_id string")
    assert {r["song_id"]: r["song_idx"] for r in catalogue.song_index_of(songs, ids).collect()} == {"A": 0, "Z": None}


def test_listen_counts_for_ids(spark, T):
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id BIGINT")
    assert rows_of(stats.listen_counts_for_ids(ids, T), "id", "listen_count") == [(1, 14), (1, 14), (9, 0)]


def test_mbtags_and_terms(spark):
    tags = spark.createDataFrame([(1, 0, "rock")], "track_id BIGINT, pos BIGINT, tag STRING")
    counts = spark.createDataFrame([(1, 0, 3)], "track_id BIGINT, pos BIGINT, count INT")
    assert rows_of(catalogue.artist_mbtags(tags, counts), "track_id", "tag", "count") == [(1, "rock", 3)]
    terms = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "track_id BIGINT, pos BIGINT, term STRING")
    freq = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25)], "track_id BIGINT, pos BIGINT, freq DOUBLE")
    weight = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5)], "track_id BIGINT, pos BIGINT, weight DOUBLE")
    joined = catalogue.artist_terms(terms, freq, weight)
    assert rows_of(joined, "pos", "term", "freq", "weight") == [(0, "a", 0.5, 1.0), (1, "b", 0.25, 0.5)]
    similar = spark.createDataFrame([(1, 1, "y"), (1, 0, "x"), (2, 0, "z")], "track_id BIGINT, pos BIGINT, artist STRING")
    rec = {r["track_id"]: r for r in catalogue.track_records(joined, similar).collect()}
    assert [t["term"] for t in rec[1]["artist_terms"]] == ["a", "b"]
    assert rec[1]["similar_artists"] == ["x", "y"] and rec[2]["artist_terms"] is None


def test_stream_equals_batch(spark, T):
    from playlens.streaming.play_stats import run_song_play_mean_stream
    got = rows_of(run_song_play_mean_stream(spark, T, n_files=3), "id", "total_play", "occurrence", "mean")
    assert got == [("1", 14, 2, 7.0), ("2", 6, 2, 3.0), ("3", 14, 2, 7.0), ("4", 4, 1, 4.0)]


def test_stream_in_batches_and_a_repeated_batch(spark, tmp_path):
    """A song that later files change has its latest row; a batch written twice counts once."""
    from playlens.streaming.play_stats import read_song_play_mean, start_song_play_mean
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("1\t7\t2\n1\t8\t4\n", "2\t7\t4\n", "3\t9\t1\n")):
        (tmp_path / "in" / f"{i}.txt").write_text(text)
    start_song_play_mean(spark, src, out, ckpt, files_per_batch=1).awaitTermination()
    want = [("7", 6, 2, 3.0), ("8", 4, 1, 4.0), ("9", 1, 1, 1.0)]
    assert rows_of(read_song_play_mean(spark, out), "id", "total_play", "occurrence", "mean") == want
    assert {p.name for p in (tmp_path / "out").glob("epoch=*")} == {"epoch=0", "epoch=1", "epoch=2"}
    sizes = [spark.read.parquet(f"{out}/epoch={i}").count() for i in range(3)]
    assert sum(sizes) == 4  # only the songs that a batch changed
    (tmp_path / "in" / "3.txt").write_text("4\t9\t5\n")  # after a restart the counts go on
    start_song_play_mean(spark, src, out, ckpt, files_per_batch=1).awaitTermination()
    assert ("9", 6, 2, 3.0) in rows_of(read_song_play_mean(spark, out), "id", "total_play", "occurrence", "mean")


def test_ragged_bounds_with_gaps(spark):
    from playlens.operators.catalogue import ragged_bounds, ragged_slice
    offsets = spark.createDataFrame([(0, 0), (2, 2), (5, 4)], "song_idx long, idx long")
    flat = spark.createDataFrame([(i, float(i)) for i in range(6)], "pos long, value double")
    assert sorted(map(tuple, ragged_bounds(offsets, flat).collect())) == [(0, 0, 2), (2, 2, 4), (5, 4, 6)]
    assert sorted((r[0], list(r[1])) for r in ragged_slice(offsets, flat).collect()) == [(0, [0.0, 1.0]), (2, [2.0, 3.0]), (5, [4.0, 5.0])]


def test_white_space_split_and_views(spark, tmp_path):
    (tmp_path / "train_triplets.txt").write_text("u-1 a.x 3\nu-2 a.x 1\n")
    (tmp_path / "user_play_mean.txt").write_text("u-1 3 1 3.0\nu-2 1 1 1.0\n")
    (tmp_path / "song_play_mean.txt").write_text("a.x 4 2 2.0\n")
    (tmp_path / "wide.txt").write_text("u-1 \t a.x  3\n\n")
    assert [tuple(r) for r in text.read_triplets_whitespace(spark, str(tmp_path / "wide.txt")).collect()] == [("u-1", "a.x", 3)]
    plays, users, songs = text.register_dataset(spark, str(tmp_path), "t_")
    assert (plays, users, songs) == ("t_triplets", "t_user_stats", "t_song_stats")
    assert spark.sql(f"SELECT p.user_id FROM {plays} p JOIN {songs} s ON p.item_id = s.id WHERE p.play_count > s.mean").collect()[0][0] == "u-1"

import pytest

from playlens.operators import preference, stats, subset
from tests.conftest import rows_of


def test_song_play_mean(T):
    got = rows_of(stats.song_play_mean(T), "id", "total_play", "occurrence", "mean")
    assert got == [(1, 14, 2, 7.0), (2, 6, 2, 3.0), (3, 14, 2, 7.0), (4, 4, 1, 4.0)]


def test_user_play_mean(T):
    got = rows_of(stats.user_play_mean(T), "id", "total_play", "occurrence", "mean")
    assert [g[:3] for g in got] == [(1, 16, 3), (2, 7, 2), (3, 15, 2)]
    assert [round(g[3], 6) for g in got] == [5.333333, 3.5, 7.5]


def test_item_liking(T):
    got = rows_of(preference.item_liking(T), "item_id", "liked", "not_liked", "total", "liking_percent")
    assert got == [(1, 1, 1, 2, 0.5), (2, 0, 1, 1, 0.0), (3, 1, 1, 2, 0.5)]   # d absent


def test_item_liking_matches_outer_join_form(T):
    a = rows_of(preference.item_liking(T, n_listeners=3), "item_id", "liked", "not_liked", "total")
    b = rows_of(preference.liking_outer_join(T), "item_id", "liked", "not_liked", "total")
    assert a == b


def test_play_histogram(T):
    got = {r["bin"]: (r["count"], r["pct"]) for r in stats.play_histogram(T).collect()}
    assert len(got) == 13
    for b in range(5):                      # counts 1..5 -> bins 0..4
        assert got[b][0] == 1 and got[b][1] == pytest.approx(100 / 7)
    for b in range(5, 10):
        assert got[b][0] == 0
    assert got[10] == (2, pytest.approx(200 / 7))   # 11 and 12 in [10.5, 25.5)
    assert got[11][0] == 0 and got[12][0] == 0


def test_histogram_last_bin_closed_and_outside_dropped(spark):
    df = spark.createDataFrame([(9967,), (9968,), (0,)], "play_count INT")
    got = {r["bin"]: (r["count"], r["pct"]) for r in stats.play_histogram(df).collect()}
    assert sum(c for c, _ in got.values()) == 1 and got[12] == (1, pytest.approx(100 / 3))
    df2 = spark.createDataFrame([(60,), (9967,), (10000,)], "play_count INT")
    got2 = {r["bin"]: (r["count"], r["pct"]) for r in stats.play_histogram(df2).collect()}
    assert got2[12][0] == 2 and got2[12][1] == pytest.approx(200 / 3)


def test_preference_class_gap(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, -0.5), (1, 3, 0.6), (1, 4, -0.7), (1, 5, 0.1)],
                               "user_id BIGINT, item_id BIGINT, score DOUBLE")
    got = dict(rows_of(preference.preference_class(df), "item_id", "preference"))
    assert got == {1: None, 2: None, 3: "liked", 4: "disliked", 5: "neutral"}
    assert preference.liked(df).count() + preference.disliked(df).count() + preference.neutral(df).count() == 3


def test_center_by_user_and_item(T):
    u = {(r["user_id"], r["item_id"]): r["score"] for r in preference.center_by_user(T).collect()}
    assert u[(1, 1)] == pytest.approx(12 - 16 / 3)
    i = {(r["user_id"], r["item_id"]): r["score"] for r in preference.center_by_item(T).collect()}
    assert i[(1, 1)] == pytest.approx(5.0)
    raw = preference.center_by_item(T, raw_order=True)
    assert raw.columns == ["item_id", "user_id", "score"]


def test_subset_pipeline_is_semi_join(T):
    item_stats = stats.song_play_mean(T)
    out = subset.extract_subset(T, item_stats, min_play=1, min_occurrence=1, min_mean=3.5, min_rows=0)
    # popular: a (occ 2, mean 7), c (occ 2, mean 7); plays > 1 on them
    assert rows_of(out, "user_id", "item_id", "play_count") == [(1, 1, 12), (1, 3, 3), (2, 1, 2), (3, 3, 11)]
    summary = subset.subset_summary(out).first()
    assert (summary["users"], summary["songs"], summary["triplets"]) == (3, 2, 4)


def test_num_distinct_counts_null(spark):
    df = spark.createDataFrame([(1,), (None,), (1,), (2,)], "x INT")
    assert df.agg(stats.num_distinct(df, "x", "n")).first()["n"] == 3


def test_frequent_and_top(T):
    fu = rows_of(stats.frequent_users(T, min_total=14), "id", "total_play")
    assert fu == [(1, 15), (3, 15)]      # plays > 1: u1 12+3, u2 2+5, u3 11+4
    assert len(stats.frequent_users(T, min_total=7).collect()) == 2
    top = stats.top_by_total(stats.frequent_songs(T, min_total=0), 2).collect()
    assert [(r["total_play"], r["id"]) for r in top] == [(14, 1), (14, 3)]

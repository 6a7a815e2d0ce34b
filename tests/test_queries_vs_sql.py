"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import pytest

from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FAST = ["scan_triplets_text", "scan_stats_text", "scan_triplets_csv", "load_dataset", "load_subset",
        "load_train_test", "scan_id_list", "scan_counts", "write_triplets", "write_stats", "save_groups",
        "listen_counts_for_ids", "center_by_item", "preference_class", "item_liking", "liking_outer_join",
        "id_index_users", "replace_ids", "user_item_matrix", "cv_folds", "group_weights",
        "group_agg_median", "group_agg_weighted_avg", "virtual_train_test", "log_weight", "item_cosine",
        "similar_items", "recommend_knn", "top_songs_by_mean", "recommend_random", "labels_by_user",
        "prediction_labels", "rank_percentile", "evaluate_knn", "evaluate_random",
        "popularity_curve_subsets", "log_occurrence_histogram", "catalogue_join", "catalogue_fields",
        "ragged_slice", "ragged_slice_2d", "song_idx_lookup", "song_index_of", "song_details",
        "artist_terms", "similar_artists", "artist_mbtags", "track_records", "stream_song_play_mean"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    import __spark_entry__ as se
    df = se.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(se.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = _rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert got == want

"""Named queries: (spark, sf_dir) -> DataFrame, one per operator.

Each query derives its inputs from the test tables (``sources.fixtures``) and
runs one operator of the library on them, over whole tables. Thresholds are
the fixture values of FIXTURES.md where the reference's defaults would select
nothing at test scale. Double columns are rounded to 6 places so the results
can be compared with the DuckDB checks in ``plans.oracle``.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.functions.columns import round_doubles
from playlens.operators import (catalogue, coverage, groups, indexing, metrics, preference, recommend,
                                similarity, split, stats, subset, tuning)
from playlens.session import scratch_path
from playlens.sources import fixtures as fx
from playlens.sources import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixture thresholds (FIXTURES.md): the reference defaults select nothing at test scale.
MIN_PLAY = 1
MIN_OCCURRENCE = 30
MIN_MEAN = 25.0
MIN_ROWS = 8
USER_MIN_TOTAL = 1000
ITEM_MIN_TOTAL = 800
SEED = 42
GROUP_SIZE = 4
KNN_K = 50
TOP_N = 20
ALS_PARAMS = (10, 0.1, 0.01)   # rank, lambda, alpha of the reference's ALS run


_LOCAL = threading.local()


def _memo(key, build):
    """Inputs shared inside one query (e.g. the checkpointed group membership),
    built once per query run; cleared before every query (per thread)."""
    memo = getattr(_LOCAL, "memo", None)
    if memo is None:
        memo = _LOCAL.memo = {}
    if key not in memo:
        memo[key] = build()
    return memo[key]


def query(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _LOCAL.memo = {}
            try:
                return round_doubles(fn(spark, sf_dir), 6)
            finally:
                _LOCAL.memo = {}
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


# ---------------------------------------------------------------- shared inputs

def _plays(spark, sf):
    kept = (getattr(_LOCAL, "memo", None) or {}).get(("plays", sf))
    return fx.plays(spark, sf) if kept is None else kept


def _written(spark, name, df):
    """``df`` written once to the scratch folder, compressed and by columns, and read back."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _keep_plays(spark, sf, ordered=False):
    """The plays of a query that reads them several times, joined and summed once; ``ordered``
    by user, so that what is made per user has one row a task, and equal ids lie together
    in what is stored and shuffled."""
    return _memo(("plays", sf), lambda: _written(spark, "plays", fx.plays(spark, sf, ordered)))


def _item_stats(spark, sf):
    return stats.song_play_mean(_plays(spark, sf))


def _user_stats(spark, sf):
    return stats.user_play_mean(_plays(spark, sf))


def _split(spark, sf):
    return split.split_train_test(_plays(spark, sf), 0.5, SEED)


def _membership(spark, sf, g=GROUP_SIZE):
    return _memo(("membership", sf, g), lambda: groups.group_users(
        _plays(spark, sf).select(F.col("user_id").alias("id")), g, SEED))


def _group_plays(spark, sf, g=GROUP_SIZE):
    return groups.form_groups(_split(spark, sf), _membership(spark, sf, g))


def _virtual(spark, sf, which, agg="normalized_avg"):
    return groups.virtual_users(_group_plays(spark, sf), agg, None, which)


def _kept_group_plays(spark, sf):
    """The group plays of a query, written once for its train side and its labels."""
    def build():
        _keep_plays(spark, sf)
        return _written(spark, "group-plays", _group_plays(spark, sf))
    return _memo(("group plays", sf), build)


def _labels(spark, sf):
    kept = ("group plays", sf) in (getattr(_LOCAL, "memo", None) or {})
    test = groups.virtual_users(_kept_group_plays(spark, sf), "normalized_avg", None, "test") if kept else _virtual(spark, sf, "test")
    return test.filter(F.col("score") != 0).select(F.col("group_id").alias("entity"), "item_id")


def _entities(spark, sf):
    return _membership(spark, sf).select(F.col("group_id").alias("entity")).distinct()


def _knn_weights(spark, sf):
    """Weights of the virtual train users, written once: norms, products and played items read them."""
    def build():
        train = groups.virtual_users(_kept_group_plays(spark, sf), "normalized_avg", None, "train")
        return _written(spark, "knn-weights", similarity.log1p_weights(train))
    return _memo(("knn weights", sf), build)


def _neighbours(spark, sf):
    return _memo(("neighbours", sf), lambda: similarity.k_similar_items(_knn_weights(spark, sf), KNN_K))


def _knn_recs(spark, sf, n):
    recs = recommend.recommend_knn(_knn_weights(spark, sf), _neighbours(spark, sf), n)
    return recs.select(F.col("row").alias("entity"), "rank", "item_id")


def _knn_padded(spark, sf, n):
    songs = _plays(spark, sf).select("item_id")
    return recommend.recommend_knn(_knn_weights(spark, sf), _neighbours(spark, sf), n, pad=True, items=songs)


def _popular_recs(spark, sf, n, by="occ"):
    return recommend.recommend_popular(_entities(spark, sf), _item_stats(spark, sf), by, n)


def _random_recs(spark, sf, n):
    return recommend.recommend_random(_entities(spark, sf), _item_stats(spark, sf), n, SEED)


def _als_model(spark, sf):
    _keep_plays(spark, sf)
    train = _virtual(spark, sf, "train").select(F.col("group_id").alias("row"), F.col("item_id").alias("item"),
                                                F.col("score").alias("rating")).filter(F.col("rating") != 0)
    return recommend.train_als(train, *ALS_PARAMS)


# ---------------------------------------------------------------- scans / sinks

@query("scan_triplets_text")
def q_scan_triplets_text(spark, sf):
    """Triplets written as space-separated text, read back by the regex splitter."""
    path = scratch_path(spark, "triplets")
    text.write_triplets(_plays(spark, sf), path)
    return text.read_triplets_text(spark, path)


@query("scan_triplets_whitespace")
def q_scan_triplets_whitespace(spark, sf):
    """Triplets written as space-separated text, read back split on white space."""
    path = scratch_path(spark, "triplets")
    text.write_triplets(_plays(spark, sf), path)
    return text.read_triplets_whitespace(spark, path)


@query("scan_stats_text")
def q_scan_stats_text(spark, sf):
    path = scratch_path(spark, "stats")
    text.write_stats(_item_stats(spark, sf), path)
    return text.read_stats_text(spark, path)


@query("scan_triplets_csv")
def q_scan_triplets_csv(spark, sf):
    path = scratch_path(spark, "csv")
    _plays(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return text.read_triplets_csv(spark, path)


def _write_dataset(spark, sf, plays, folder):
    text.write_triplets(plays, f"{folder}/train_triplets.txt")
    text.write_stats(stats.user_play_mean(plays), f"{folder}/user_play_mean.txt")
    text.write_stats(stats.song_play_mean(plays), f"{folder}/song_play_mean.txt")


@query("load_dataset")
def q_load_dataset(spark, sf):
    """Triplets with the user and song means, all three read from text."""
    folder = scratch_path(spark, "dataset")
    _write_dataset(spark, sf, _keep_plays(spark, sf, ordered=True), folder)
    trip, users, songs = text.load_dataset(spark, folder)
    um = users.select(F.col("id").alias("user_id"), F.col("mean").alias("user_mean"))
    sm = songs.select(F.col("id").alias("item_id"), F.col("mean").alias("song_mean"))
    return trip.join(um, "user_id").join(sm, "item_id")


@query("dataset_views")
def q_dataset_views(spark, sf):
    """The three text tables as temporary views, asked in SQL: for each user the
    rows whose count is above the song's mean."""
    folder = scratch_path(spark, "dataset")
    _write_dataset(spark, sf, _keep_plays(spark, sf, ordered=True), folder)
    plays, users, songs = text.register_dataset(spark, folder, "playlens_")
    return spark.sql(f"""SELECT p.user_id, max(u.mean) AS user_mean, count(*) AS n_above, sum(p.play_count) AS plays_above
                         FROM {plays} p JOIN {users} u ON p.user_id = u.id JOIN {songs} s ON p.item_id = s.id
                         WHERE p.play_count > s.mean GROUP BY p.user_id""")


@query("load_subset")
def q_load_subset(spark, sf):
    """Each market segment written as its own subset folder; all read back at once."""
    root = scratch_path(spark, "subsets")
    text.write_subsets(fx.plays_subsets(spark, sf), root)
    return text.load_subsets(spark, root)


@query("load_train_test")
def q_load_train_test(spark, sf):
    folder = scratch_path(spark, "traintest")
    s = _split(spark, sf)
    text.write_triplets(s.filter(F.col("split") == "train"), f"{folder}/train_triplets.txt")
    text.write_triplets(s.filter(F.col("split") == "test"), f"{folder}/test_triplets.txt")
    train, test = text.load_train_test(spark, folder)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("scan_id_list")
def q_scan_id_list(spark, sf):
    path = scratch_path(spark, "ids")
    fx.id_list_items(spark, sf).select(F.col("id").cast("string").alias("value")).write.text(path)
    return text.read_id_list(spark, path)


@query("scan_counts")
def q_scan_counts(spark, sf):
    path = scratch_path(spark, "counts")
    _plays(spark, sf).select(F.col("play_count").cast("string").alias("value")).write.text(path)
    return text.read_counts(spark, path)


@query("save_groups")
def q_save_groups(spark, sf):
    """Groups of 4 and 12 stored by size and split; size 4 read back (pruned)."""
    path = scratch_path(spark, "groups")
    s = _split(spark, sf)
    for g in (4, 12):
        text.save_groups(groups.form_groups(s, _membership(spark, sf, g)), path, g)
    return text.load_groups(spark, path, 4)


@query("write_triplets")
def q_write_triplets(spark, sf):
    """The extracted subset written as text and read back."""
    path = scratch_path(spark, "subset")
    text.write_triplets(_subset(spark, sf), path)
    return text.read_triplets_text(spark, path)


@query("write_stats")
def q_write_stats(spark, sf):
    path = scratch_path(spark, "ustats")
    text.write_stats(_user_stats(spark, sf), path)
    return text.read_stats_text(spark, path)


# ---------------------------------------------------------------- subset and filters

def _subset(spark, sf):
    return subset.extract_subset(_plays(spark, sf), _item_stats(spark, sf), MIN_PLAY, MIN_OCCURRENCE,
                                 MIN_MEAN, MIN_ROWS)


@query("extract_subset")
def q_extract_subset(spark, sf):
    return _subset(spark, sf)


@query("subset_summary")
def q_subset_summary(spark, sf):
    return subset.subset_summary(_subset(spark, sf))


@query("filter_min_plays")
def q_filter_min_plays(spark, sf):
    return subset.filter_min_plays(_plays(spark, sf), MIN_PLAY)


@query("popular_items")
def q_popular_items(spark, sf):
    return subset.popular_items(_item_stats(spark, sf), MIN_OCCURRENCE, MIN_MEAN)


@query("join_popular_items")
def q_join_popular_items(spark, sf):
    return subset.join_popular_items(subset.filter_min_plays(_plays(spark, sf), MIN_PLAY),
                                     subset.popular_items(_item_stats(spark, sf), MIN_OCCURRENCE, MIN_MEAN))


@query("active_users")
def q_active_users(spark, sf):
    kept = subset.join_popular_items(subset.filter_min_plays(_plays(spark, sf), MIN_PLAY),
                                     subset.popular_items(_item_stats(spark, sf), MIN_OCCURRENCE, MIN_MEAN))
    return subset.active_users(kept, MIN_ROWS)


@query("join_active_users")
def q_join_active_users(spark, sf):
    return _subset(spark, sf)


# ---------------------------------------------------------------- statistics

@query("song_play_mean")
def q_song_play_mean(spark, sf):
    return _item_stats(spark, sf)


@query("user_play_mean")
def q_user_play_mean(spark, sf):
    return _user_stats(spark, sf)


@query("frequent_users")
def q_frequent_users(spark, sf):
    return stats.frequent_users(_plays(spark, sf), USER_MIN_TOTAL, MIN_PLAY)


@query("frequent_songs")
def q_frequent_songs(spark, sf):
    return stats.frequent_songs(_plays(spark, sf), ITEM_MIN_TOTAL, MIN_PLAY)


@query("top_users")
def q_top_users(spark, sf):
    return stats.top_by_total(stats.frequent_users(_plays(spark, sf), USER_MIN_TOTAL, MIN_PLAY), 10)


@query("top_songs")
def q_top_songs(spark, sf):
    return stats.top_by_total(stats.frequent_songs(_plays(spark, sf), ITEM_MIN_TOTAL, MIN_PLAY), 10)


@query("frequent_summary")
def q_frequent_summary(spark, sf):
    return stats.frequent_summary(_plays(spark, sf), USER_MIN_TOTAL, ITEM_MIN_TOTAL, MIN_PLAY)


@query("num_distinct")
def q_num_distinct(spark, sf):
    p = _plays(spark, sf)
    return p.agg(stats.num_distinct(p, "user_id", "distinct_users"),
                 stats.num_distinct(p, "item_id", "distinct_items"))


@query("overall_play_mean")
def q_overall_play_mean(spark, sf):
    return stats.overall_play_mean(_plays(spark, sf))


@query("distinct_users")
def q_distinct_users(spark, sf):
    return stats.distinct_values(_plays(spark, sf), "user_id")


@query("distinct_songs")
def q_distinct_songs(spark, sf):
    return stats.distinct_values(_plays(spark, sf), "item_id")


@query("play_histogram")
def q_play_histogram(spark, sf):
    return stats.play_histogram(_plays(spark, sf))


@query("play_histogram_pct")
def q_play_histogram_pct(spark, sf):
    return stats.play_histogram(_plays(spark, sf)).select("bin", "pct")


@query("listen_counts_for_ids")
def q_listen_counts_for_ids(spark, sf):
    return stats.listen_counts_for_ids(fx.id_list_items(spark, sf), _plays(spark, sf))


# ---------------------------------------------------------------- preference

@query("center_by_user")
def q_center_by_user(spark, sf):
    return preference.center_by_user(_plays(spark, sf), _user_stats(spark, sf))


@query("center_by_item")
def q_center_by_item(spark, sf):
    return preference.center_by_item(_plays(spark, sf), _item_stats(spark, sf))


@query("preference_class")
def q_preference_class(spark, sf):
    return preference.preference_class(preference.center_by_user(_plays(spark, sf)))


for _name, _fn, _by in (("liked_by_user_mean", preference.liked, "user"),
                        ("disliked_by_user_mean", preference.disliked, "user"),
                        ("neutral_by_user_mean", preference.neutral, "user"),
                        ("liked_by_item_mean", preference.liked, "item"),
                        ("disliked_by_item_mean", preference.disliked, "item"),
                        ("neutral_by_item_mean", preference.neutral, "item")):
    def _make(fn=_fn, by=_by):
        def q(spark, sf):
            p = _plays(spark, sf)
            centred = preference.center_by_user(p) if by == "user" else preference.center_by_item(p)
            return fn(centred)
        return q
    query(_name)(_make())


@query("item_liking")
def q_item_liking(spark, sf):
    return preference.item_liking(_plays(spark, sf))


@query("liking_outer_join")
def q_liking_outer_join(spark, sf):
    return preference.liking_outer_join(_plays(spark, sf))


def _member_pairs(spark, sf):
    """Each group member paired with the next member of its group."""
    m = _membership(spark, sf)
    a = m.select("group_id", F.col("user_id").alias("user_u"))
    b = m.select("group_id", F.col("user_id").alias("user_v"))
    nxt = (a.join(b, "group_id").filter(F.col("user_v") > F.col("user_u"))
            .groupBy("group_id", "user_u").agg(F.min("user_v").alias("user_v")))
    return nxt.select("user_u", "user_v")


@query("user_similarity")
def q_user_similarity(spark, sf):
    return preference.user_similarity(preference.center_by_user(_plays(spark, sf)), _member_pairs(spark, sf))


@query("user_similarity_crosssum")
def q_user_similarity_crosssum(spark, sf):
    return preference.user_similarity(preference.center_by_user(_plays(spark, sf)), _member_pairs(spark, sf),
                                      "crosssum")


# ---------------------------------------------------------------- indexing

@query("id_index_users")
def q_id_index_users(spark, sf):
    return indexing.index_ids(fx.id_list_users(spark, sf))


@query("id_index_items")
def q_id_index_items(spark, sf):
    return indexing.index_ids(fx.id_list_items(spark, sf))


@query("replace_ids")
def q_replace_ids(spark, sf):
    return indexing.replace_ids(_plays(spark, sf), indexing.index_ids(fx.id_list_users(spark, sf)),
                                indexing.index_ids(fx.id_list_items(spark, sf)))


@query("replace_ids_keep")
def q_replace_ids_keep(spark, sf):
    """Customers of the first market segment and all songs: IDs outside keep a null index."""
    some = fx.table(spark, sf, "customer").filter(F.col("c_mktsegment") < "C").select(F.col("c_custkey").alias("id"))
    return indexing.replace_ids(_plays(spark, sf), indexing.index_ids(some), indexing.index_ids(fx.id_list_items(spark, sf)), unknown="keep")


@query("user_item_matrix")
def q_user_item_matrix(spark, sf):
    """Raw order lines as repeated (user, song) lines; the last line wins.

    Lines are ordered by (order key, line number, quantity): the test tables
    repeat some (order key, line number) pairs, and the quantity breaks those ties.
    """
    lines = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "orders"),
                                                F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                         F.col("l_quantity").cast("int").alias("play_count"),
                         ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000
                          + F.col("l_quantity").cast("int")).alias("line_no"))
    return indexing.user_item_matrix(lines, indexing.index_ids(fx.id_list_users(spark, sf)),
                                     indexing.index_ids(fx.id_list_items(spark, sf)))


# ---------------------------------------------------------------- splitting

@query("split_train")
def q_split_train(spark, sf):
    return _split(spark, sf).filter(F.col("split") == "train").drop("split")


@query("split_test")
def q_split_test(spark, sf):
    return _split(spark, sf).filter(F.col("split") == "test").drop("split")


@query("cv_folds")
def q_cv_folds(spark, sf):
    return split.cv_folds(_plays(spark, sf), 5, SEED)


@query("cv_fold_train")
def q_cv_fold_train(spark, sf):
    return split.cv_fold_train(split.cv_folds(_plays(spark, sf), 5, SEED), 0)


@query("cv_fold_test")
def q_cv_fold_test(spark, sf):
    return split.cv_fold_test(split.cv_folds(_plays(spark, sf), 5, SEED), 0)


# ---------------------------------------------------------------- groups

@query("group_users")
def q_group_users(spark, sf):
    return _membership(spark, sf)


@query("form_groups")
def q_form_groups(spark, sf):
    return _group_plays(spark, sf)


@query("load_groups")
def q_load_groups(spark, sf):
    path = scratch_path(spark, "groups4")
    text.save_groups(_group_plays(spark, sf), path, GROUP_SIZE)
    return text.load_groups(spark, path, GROUP_SIZE)


@query("group_weights")
def q_group_weights(spark, sf):
    return groups.group_weights(_membership(spark, sf), _user_stats(spark, sf))


for _agg in ("avg", "normalized_avg", "least_misery", "median", "weighted_avg"):
    def _make_agg(agg=_agg):
        def q(spark, sf):
            gp = _group_plays(spark, sf).filter(F.col("split") == "train")
            w = groups.group_weights(_membership(spark, sf), _user_stats(spark, sf)) if agg == "weighted_avg" else None
            return groups.group_aggregate_scores(gp, agg, w)
        return q
    query(f"group_agg_{_agg}")(_make_agg())


@query("virtual_users")
def q_virtual_users(spark, sf):
    return _virtual(spark, sf, "train")


WIDE_TOP = 20   # columns of the wide virtual-user table: the most played songs


@query("virtual_users_wide")
def q_virtual_users_wide(spark, sf):
    """Virtual users as a group x song table over the 20 songs with most rows
    (columns top1..top20 by that rank)."""
    top = recommend.top_items(_item_stats(spark, sf), "occ", WIDE_TOP).orderBy("rank").collect()
    items = [r["item_id"] for r in top]
    return groups.virtual_users_wide(_virtual(spark, sf, "train"), items,
                                     [f"top{r['rank']}" for r in top])


@query("virtual_user_blocks")
def q_virtual_user_blocks(spark, sf):
    """Virtual users as a group x song table over all songs, in non-empty blocks."""
    songs = indexing.index_ids(_keep_plays(spark, sf), "item_id")
    # rounded before the zeros are filled in, a thousand for each score
    return groups.virtual_user_blocks(_virtual(spark, sf, "train").withColumn("score", F.round("score", 6)), songs)


@query("virtual_train_test")
def q_virtual_train_test(spark, sf):
    train, test = groups.virtual_train_test(_group_plays(spark, sf), _user_stats(spark, sf),
                                            _membership(spark, sf), "normalized_avg")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("rating_tuples")
def q_rating_tuples(spark, sf):
    v = _virtual(spark, sf, "train").filter(F.col("score") != 0)
    return v.select(F.col("group_id").alias("row"), "item_id", F.col("score").alias("rating"))


# ---------------------------------------------------------------- similarity and kNN

@query("log_weight")
def q_log_weight(spark, sf):
    return similarity.log_weights(_plays(spark, sf))


@query("log1p_weight")
def q_log1p_weight(spark, sf):
    return _knn_weights(spark, sf)


@query("item_cosine")
def q_item_cosine(spark, sf):
    """All nonzero cosines between songs over plain users (ln(play) + 1 weights)."""
    return similarity.item_cosine(similarity.log_weights(_plays(spark, sf)))


@query("item_cosine_groups")
def q_item_cosine_groups(spark, sf):
    return similarity.item_cosine(_knn_weights(spark, sf))


@query("k_similar_items")
def q_k_similar_items(spark, sf):
    return _neighbours(spark, sf)


@query("similar_items")
def q_similar_items(spark, sf):
    """The 30 nearest songs of every song over plain users, looked up in the table
    of the 50 nearest."""
    plays = _plays(spark, sf)
    return similarity.similar_items(similarity.k_similar_items(similarity.log_weights(plays), 50), plays, 30)


@query("predict_knn")
def q_predict_knn(spark, sf):
    return recommend.predict_knn(_knn_weights(spark, sf), _neighbours(spark, sf))


@query("recommend_knn")
def q_recommend_knn(spark, sf):
    recs = recommend.recommend_knn(_knn_weights(spark, sf), _neighbours(spark, sf), TOP_N)
    return recs


@query("recommend_knn_padded")
def q_recommend_knn_padded(spark, sf):
    """Lists of 200 songs: zero scores fill up what the positive ones leave."""
    return _knn_padded(spark, sf, max(metrics.N_LIST))


# ---------------------------------------------------------------- popularity / random

@query("top_songs_by_total")
def q_top_songs_by_total(spark, sf):
    return recommend.top_items(_item_stats(spark, sf), "tot", TOP_N)


@query("top_songs_by_occurrence")
def q_top_songs_by_occurrence(spark, sf):
    return recommend.top_items(_item_stats(spark, sf), "occ", TOP_N)


@query("top_songs_by_mean")
def q_top_songs_by_mean(spark, sf):
    return recommend.top_items(_item_stats(spark, sf), "mean", TOP_N)


for _by in ("occ", "tot", "mean"):
    def _make_pop(by=_by):
        def q(spark, sf):
            users = _plays(spark, sf).select(F.col("user_id").alias("entity")).distinct()
            return recommend.recommend_popular(users, _item_stats(spark, sf), by, TOP_N)
        return q
    query(f"recommend_popular_{_by}")(_make_pop())


@query("recommend_random")
def q_recommend_random(spark, sf):
    users = _plays(spark, sf).select(F.col("user_id").alias("entity")).distinct()
    return recommend.recommend_random(users, _item_stats(spark, sf), TOP_N, SEED)


# ---------------------------------------------------------------- lists and metrics

@query("recs_by_user")
def q_recs_by_user(spark, sf):
    r = metrics.recs_by_entity(_popular_recs(spark, sf, TOP_N))
    return r.select("entity", "n", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


@query("labels_by_user")
def q_labels_by_user(spark, sf):
    r = metrics.labels_by_entity(_labels(spark, sf))
    return r.select("entity", "n", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


@query("label_blocks")
def q_label_blocks(spark, sf):
    """Each group's labels in bounded arrays."""
    r = metrics.label_blocks(_labels(spark, sf), indexing.index_ids(_plays(spark, sf), "item_id"), 128)
    return r.select("entity", "block", "n", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


@query("prediction_labels")
def q_prediction_labels(spark, sf):
    pl = metrics.prediction_labels(_knn_recs(spark, sf, TOP_N), _labels(spark, sf))
    s = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return pl.select("entity", s("recs").alias("recs"), s("labels").alias("labels"))


@query("hit_counts")
def q_hit_counts(spark, sf):
    return metrics.hit_counts(_knn_recs(spark, sf, TOP_N), _labels(spark, sf))


@query("rank_percentile")
def q_rank_percentile(spark, sf):
    return metrics.rank_percentile(_knn_recs(spark, sf, TOP_N), _labels(spark, sf))


for _m in metrics.METRIC_COLUMNS:
    def _make_metric(m=_m):
        def q(spark, sf):
            return metrics.metric(_popular_recs(spark, sf, TOP_N), _labels(spark, sf), m)
        return q
    query("metric_ndcg10" if _m == "ndcg" else f"metric_{_m}")(_make_metric())


@query("evaluate_rankings")
def q_evaluate_rankings(spark, sf):
    return metrics.ranking_metrics(_knn_recs(spark, sf, TOP_N), _labels(spark, sf))


@query("evaluate_knn")
def q_evaluate_knn(spark, sf):
    return metrics.evaluate_at(_knn_recs(spark, sf, max(metrics.N_LIST)), _labels(spark, sf))


@query("evaluate_knn_padded")
def q_evaluate_knn_padded(spark, sf):
    """The kNN sweep over full lists, every group included."""
    recs = _knn_padded(spark, sf, max(metrics.N_LIST)).withColumnRenamed("row", "entity")
    return metrics.evaluate_at(recs, _labels(spark, sf))


@query("evaluate_popular")
def q_evaluate_popular(spark, sf):
    _keep_plays(spark, sf)
    ranked = recommend.top_items(_item_stats(spark, sf), "occ", max(metrics.N_LIST))
    return metrics.evaluate_same_list(ranked, _entities(spark, sf), _labels(spark, sf))


@query("evaluate_random")
def q_evaluate_random(spark, sf):
    _keep_plays(spark, sf)
    ranked = recommend.random_items(_item_stats(spark, sf), max(metrics.N_LIST), SEED)
    return metrics.evaluate_same_list(ranked, _entities(spark, sf), _labels(spark, sf))


# ---------------------------------------------------------------- ALS (rows-only checks)

@query("train_als")
def q_train_als(spark, sf):
    model = _als_model(spark, sf)
    return model.userFactors.select(F.col("id").alias("row"), F.size("features").alias("rank"))


@query("top_n_factors")
def q_top_n_factors(spark, sf):
    """The 20 best vectors for every vector by inner product: the blocked top n of factor
    models over the embeddings."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    top = recommend.top_n_from_factors(rows, rows, TOP_N)
    return top.select(F.col("r").alias("row"), F.col("rank").cast("int").alias("rank"), F.col("q").alias("item_id"), F.col("v").alias("score"))


@query("recommend_als")
def q_recommend_als(spark, sf):
    return recommend.recommend_als(_als_model(spark, sf), TOP_N)


def _als_train(spark, sf):
    """Virtual train users out of the written group plays, which the labels read too."""
    return groups.virtual_users(_kept_group_plays(spark, sf), "normalized_avg", None, "train")


@query("evaluate_als")
def q_evaluate_als(spark, sf):
    train = _als_train(spark, sf).withColumnRenamed("group_id", "entity")
    return tuning.evaluate_als(train, _labels(spark, sf), *ALS_PARAMS, ns=[TOP_N])


@query("evaluate_als_sweep")
def q_evaluate_als_sweep(spark, sf):
    train = _als_train(spark, sf).withColumnRenamed("group_id", "entity")
    return tuning.evaluate_als(train, _labels(spark, sf), *ALS_PARAMS)


# The reference's search: every rank x lambda x alpha, in that nesting order.
CV_RANKS = (5, 10, 50, 100, 200)
CV_LAMBDAS = CV_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
CV_GRID = tuple(itertools.product(CV_RANKS, CV_LAMBDAS, CV_ALPHAS))


def _cv_folded(spark, sf):
    """(entity, item_id, score, fold) of the virtual users of all plays."""
    folded = split.cv_folds(_virtual(spark, sf, None).select(
        F.col("group_id").alias("user_id"), "item_id", F.col("score").alias("play_count")), 2, SEED)
    return folded.select(F.col("user_id").alias("entity"), "item_id", F.col("play_count").alias("score"), "fold")


#: Where a session has written the scores of a grid: the queries on them read one run.
_SCORES: dict[tuple, str] = {}


def _cv_scores(spark, sf, grid=CV_GRID):
    key = (spark.sparkContext.applicationId, sf, grid)
    if key not in _SCORES:
        path = scratch_path(spark, "cv-scores")
        tuning.cross_validate(_cv_folded(spark, sf), grid, n=200, cv=2).write.parquet(path)
        _SCORES[key] = path
    return spark.read.parquet(_SCORES[key])


#: Parameter sets of the popularity recommender.
POPULAR_GRID = ("occ", "tot", "mean")


def _cv_popular(spark, sf):
    folded = split.cv_folds(_keep_plays(spark, sf), 5, SEED)
    cells = folded.select(F.col("user_id").alias("entity"), "item_id", F.col("play_count").alias("score"), "fold")
    return tuning.cross_validate(cells, POPULAR_GRID, n=200, cv=5, fit=tuning.popular_lists(200))


def _grid_scan(spark, sf, grid=CV_GRID):
    train = _als_train(spark, sf).withColumnRenamed("group_id", "entity")
    return tuning.grid_scan(train, _labels(spark, sf), grid, 200)


@query("cross_validate")
def q_cross_validate(spark, sf):
    return _cv_scores(spark, sf)


@query("cv_summary")
def q_cv_summary(spark, sf):
    return tuning.cv_summary(_cv_scores(spark, sf))


@query("cv_best_params")
def q_cv_best_params(spark, sf):
    return tuning.cv_best_params(tuning.cv_summary(_cv_scores(spark, sf)))


@query("cross_validate_popular")
def q_cross_validate_popular(spark, sf):
    """Five folds of all plays x three popularity recommenders."""
    return _cv_popular(spark, sf)


@query("cv_summary_popular")
def q_cv_summary_popular(spark, sf):
    return tuning.cv_summary(_cv_popular(spark, sf))


@query("cv_best_params_popular")
def q_cv_best_params_popular(spark, sf):
    return tuning.cv_best_params(tuning.cv_summary(_cv_popular(spark, sf)))


@query("grid_scan")
def q_grid_scan(spark, sf):
    return _grid_scan(spark, sf)


# ---------------------------------------------------------------- coverage

@query("popularity_statistics")
def q_popularity_statistics(spark, sf):
    return coverage.popularity_statistics(_plays(spark, sf), 50)


@query("popularity_curve")
def q_popularity_curve(spark, sf):
    return coverage.popularity_curve(_plays(spark, sf))


@query("popularity_curve_subsets")
def q_popularity_curve_subsets(spark, sf):
    return coverage.popularity_curve_subsets(fx.plays_subsets(spark, sf))


@query("log_occurrence_histogram")
def q_log_occurrence_histogram(spark, sf):
    return coverage.log_occurrence_histogram(_item_stats(spark, sf))


@query("occurrence_vs_total")
def q_occurrence_vs_total(spark, sf):
    return coverage.occurrence_vs_total(_item_stats(spark, sf))


# ---------------------------------------------------------------- catalogue

def _songs(spark, sf):
    return catalogue.catalogue_join(fx.catalogue_metadata(spark, sf), fx.catalogue_analysis(spark, sf),
                                    fx.catalogue_musicbrainz(spark, sf))


def _played_song_ids(spark, sf):
    return _plays(spark, sf).select(
        F.concat(F.lit("SO"), F.lpad(F.col("item_id").cast("string"), 10, "0")).alias("song_id")).distinct()


@query("catalogue_join")
def q_catalogue_join(spark, sf):
    return _songs(spark, sf)


@query("catalogue_count")
def q_catalogue_count(spark, sf):
    return catalogue.catalogue_count(_songs(spark, sf))


@query("catalogue_fields")
def q_catalogue_fields(spark, sf):
    return catalogue.catalogue_fields(_songs(spark, sf), ["title", "duration", "year"])


@query("catalogue_scalars")
def q_catalogue_scalars(spark, sf):
    """Every scalar field of every song, read by name out of its group."""
    names = [n for n, f in catalogue.FIELDS.items() if f.offset is None]
    return catalogue.scalar_fields(fx.catalogue_groups(spark, sf), names)


@query("catalogue_arrays")
def q_catalogue_arrays(spark, sf):
    """Every array field of every song, cut by its own offset column; rows of numbers
    one number a row (j)."""
    names = [n for n, f in catalogue.FIELDS.items() if f.offset is not None]
    found = catalogue.array_fields(fx.catalogue_offsets(spark, sf), fx.catalogue_arrays(spark, sf), names)
    cells = F.when(F.col("row").isNull(), F.array("num")).otherwise(F.col("row"))
    return found.select("field", "song_idx", "i", F.posexplode(cells).alias("j", "num"), "txt")


@query("ragged_slice_arrays")
def q_ragged_slice_arrays(spark, sf):
    """Each song's slice as one array (its values as text, in order)."""
    found = catalogue.ragged_slice(fx.ragged_songs(spark, sf), fx.ragged_flat(spark, sf))
    return found.select("song_idx", F.size("values").alias("n"),
                        F.concat_ws(",", F.transform("values", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string"))).alias("thousandths"))


@query("ragged_slice")
def q_ragged_slice(spark, sf):
    return catalogue.ragged_slice_long(fx.ragged_songs(spark, sf), fx.ragged_flat(spark, sf))


@query("ragged_slice_2d")
def q_ragged_slice_2d(spark, sf):
    long = catalogue.ragged_slice_long(fx.ragged_songs_2d(spark, sf), fx.ragged_flat_2d(spark, sf))
    return long.select("song_idx", "i", F.posexplode("value").alias("j", "value"))


@query("song_idx_lookup")
def q_song_idx_lookup(spark, sf):
    return catalogue.song_idx_lookup(_songs(spark, sf), _played_song_ids(spark, sf))


@query("song_index_of")
def q_song_index_of(spark, sf):
    """Position of every played song ID (the single-ID lookup applied to all)."""
    return catalogue.song_index_of(_songs(spark, sf), _played_song_ids(spark, sf))


@query("song_details")
def q_song_details(spark, sf):
    return catalogue.song_details(_songs(spark, sf), _played_song_ids(spark, sf))


def _terms(spark, sf):
    return fx.document_terms(spark, sf)


@query("artist_terms")
def q_artist_terms(spark, sf):
    t = _written(spark, "terms", _terms(spark, sf))
    return catalogue.artist_terms(t.select("track_id", "pos", "term"), t.select("track_id", "pos", "freq"),
                                  t.select("track_id", "pos", "weight"))


@query("similar_artists")
def q_similar_artists(spark, sf):
    return catalogue.similar_artists(fx.similar_artist_rows(spark, sf))


@query("artist_mbtags")
def q_artist_mbtags(spark, sf):
    tags, counts = fx.artist_mbtag_rows(spark, sf)
    return catalogue.artist_mbtags(tags, counts)


@query("track_records")
def q_track_records(spark, sf):
    rec = catalogue.track_records(_terms(spark, sf), fx.similar_artist_rows(spark, sf))
    return rec.select("track_id", F.size(F.coalesce("artist_terms", F.array())).alias("n_terms"),
                      F.concat_ws(",", F.coalesce("similar_artists", F.array().cast("array<string>")))
                       .alias("similar_artists"))


@query("track_record_terms")
def q_track_record_terms(spark, sf):
    """The terms of every nested track record with frequency and weight, in order."""
    rec = catalogue.track_records(_terms(spark, sf), fx.similar_artist_rows(spark, sf))
    rows = rec.select("track_id", F.posexplode("artist_terms").alias("pos", "t"))
    return rows.select("track_id", F.col("pos").cast("bigint").alias("pos"), "t.term", "t.freq", "t.weight")


# ---------------------------------------------------------------- streaming

@query("stream_song_play_mean")
def q_stream_song_play_mean(spark, sf):
    from playlens.streaming.play_stats import run_song_play_mean_stream
    return run_song_play_mean_stream(spark, _plays(spark, sf))

"""Dense-subset extraction: drop single plays, keep popular songs and active users.

The reference joins with the qualifying songs and users and drops the key copy;
both are existence tests, written here as left-semi joins. The popular-song
table is the precomputed song statistics (not recomputed on the filtered
rows), and active users are counted once, after the song filter, without
iterating to a fixed point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.operators.stats import num_distinct
from playlens.session import ensure_checkpoint_dir


def filter_min_plays(plays: DataFrame, min_play: int = 1) -> DataFrame:
    """Rows with play_count > min_play (strict)."""
    return plays.filter(F.col("play_count") > min_play)


def popular_items(item_stats: DataFrame, min_occurrence: int = 500, min_mean: float = 4.0) -> DataFrame:
    """IDs of songs with occurrence > min_occurrence and mean > min_mean (both strict)."""
    return item_stats.filter((F.col("occurrence") > min_occurrence) & (F.col("mean") > min_mean)).select("id")


def join_popular_items(plays: DataFrame, popular: DataFrame) -> DataFrame:
    """Rows whose song is popular (semi-join: songs are unique, no fan-out).

    AQE turns this into a broadcast semi-join when the popular list is small at
    run time, else a shuffle semi-join; no size is assumed here.
    """
    return plays.join(popular.select(F.col("id").alias("item_id")), "item_id", "left_semi") \
                .select("user_id", "item_id", "play_count")


def active_users(plays: DataFrame, min_rows: int = 20) -> DataFrame:
    """IDs of users with more than ``min_rows`` rows."""
    return (plays.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
                 .filter(F.col("_n") > min_rows).select("id"))


def join_active_users(plays: DataFrame, active: DataFrame) -> DataFrame:
    return plays.join(active.select(F.col("id").alias("user_id")), "user_id", "left_semi") \
                .select("user_id", "item_id", "play_count")


def extract_subset(plays: DataFrame, item_stats: DataFrame, min_play: int = 1,
                   min_occurrence: int = 500, min_mean: float = 4.0, min_rows: int = 20,
                   materialize: bool = True) -> DataFrame:
    """plays > min_play, on popular songs, of users with > min_rows such rows.

    The song-filtered rows are read twice (user counts, then the semi-join);
    with ``materialize`` they are written once as a reliable checkpoint in the
    shared folder, so the input plan is not run twice and lineage is cut.
    """
    kept = join_popular_items(filter_min_plays(plays, min_play),
                              popular_items(item_stats, min_occurrence, min_mean))
    if materialize:
        ensure_checkpoint_dir(plays.sparkSession)
        kept = kept.checkpoint(eager=True)
    return join_active_users(kept, active_users(kept, min_rows))


def subset_summary(subset: DataFrame) -> DataFrame:
    """One row: distinct users, distinct songs, triplets."""
    return subset.agg(num_distinct(subset, "user_id", "users"),
                      num_distinct(subset, "item_id", "songs"),
                      F.count(F.lit(1)).alias("triplets"))

"""Play statistics: per-entity means, frequent entities, counts, histograms.

All aggregates are single ``groupBy.agg`` passes, so Spark combines them
map-side (partial hash aggregate) before the shuffle on the key; a key that
holds a third of all rows is reduced to one row per map task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed bin edges of the play-count histogram (must equal the reference's).
PLAY_HISTOGRAM_EDGES = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5, 25.5, 50.5, 9967.5)


def entity_play_mean(plays: DataFrame, key: str) -> DataFrame:
    """(id, total_play BIGINT, occurrence BIGINT, mean DOUBLE) per ``key``.

    One aggregate replaces the reference's join of a sum table with a count
    table; rows with a null key are dropped, as the inner join did.
    """
    return (plays.filter(F.col(key).isNotNull())
                 .groupBy(F.col(key).alias("id"))
                 .agg(F.sum("play_count").cast("bigint").alias("total_play"),
                      F.count(F.lit(1)).alias("occurrence"))
                 .withColumn("mean", F.col("total_play") / F.col("occurrence")))


def song_play_mean(plays: DataFrame) -> DataFrame:
    return entity_play_mean(plays, "item_id")


def user_play_mean(plays: DataFrame) -> DataFrame:
    return entity_play_mean(plays, "user_id")


def frequent_entities(plays: DataFrame, key: str, min_total: int = 100,
                      min_play: int = 1) -> DataFrame:
    """(id, total_play): plays > min_play, summed per key, total > min_total."""
    return (plays.filter(F.col("play_count") > min_play)
                 .groupBy(F.col(key).alias("id"))
                 .agg(F.sum("play_count").cast("bigint").alias("total_play"))
                 .filter(F.col("total_play") > min_total))


def frequent_users(plays: DataFrame, min_total: int = 100, min_play: int = 1) -> DataFrame:
    return frequent_entities(plays, "user_id", min_total, min_play)


def frequent_songs(plays: DataFrame, min_total: int = 100, min_play: int = 1) -> DataFrame:
    return frequent_entities(plays, "item_id", min_total, min_play)


def top_by_total(frequent: DataFrame, n: int = 10) -> DataFrame:
    """(total_play, id): the n largest totals; ties by id (TakeOrderedAndProject)."""
    return frequent.select("total_play", "id").orderBy(F.col("total_play").desc(), F.col("id")).limit(n)


def frequent_summary(plays: DataFrame, user_min_total: int = 100, item_min_total: int = 100,
                     min_play: int = 1) -> DataFrame:
    """One row: number of frequent users and of frequent songs."""
    users = frequent_users(plays, user_min_total, min_play).select(F.lit("u").alias("_kind"))
    songs = frequent_songs(plays, item_min_total, min_play).select(F.lit("s").alias("_kind"))
    both = users.unionByName(songs)
    return both.agg(F.count_if(F.col("_kind") == "u").alias("frequent_users"),
                    F.count_if(F.col("_kind") == "s").alias("frequent_songs"))


def num_distinct(df: DataFrame, col: str, alias: str | None = None) -> Column:
    """Distinct count where null counts as one value (``select(c).distinct().count()``)."""
    c = F.col(col)
    expr = F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
    return expr.alias(alias or f"distinct_{col}")


def overall_play_mean(plays: DataFrame) -> DataFrame:
    """One row: total plays, number of rows, mean play."""
    return plays.agg(F.sum("play_count").cast("bigint").alias("total_play"),
                     F.count(F.lit(1)).alias("rows"),
                     F.avg(F.col("play_count").cast("double")).alias("mean_play"))


def distinct_values(plays: DataFrame, key: str) -> DataFrame:
    return plays.select(F.col(key).alias("id")).distinct()


def _bin_of(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``value``: [a, b) bins, the last one closed; null outside."""
    last = len(edges) - 2
    expr = F.when(value == F.lit(float(edges[-1])), F.lit(last))
    for i in range(last, -1, -1):
        expr = expr.when((value >= F.lit(float(edges[i]))) & (value < F.lit(float(edges[i + 1]))), F.lit(i))
    return expr


def play_histogram(plays: DataFrame, edges: Sequence[float] = PLAY_HISTOGRAM_EDGES,
                   value: str = "play_count") -> DataFrame:
    """(bin, lo, hi, count, pct): counts per bin, empty bins kept as 0.

    ``pct`` divides by all rows, inside the edges or not. One pass: a count per
    bin plus the row total in a single (partially aggregated) aggregate, then
    unpivoted into one row per bin.
    """
    v = F.col(value).cast("double")
    b = _bin_of(v, edges)
    n_bins = len(edges) - 1
    counts = plays.agg(*[F.count_if(b == i).alias(f"c{i}") for i in range(n_bins)],
                       F.count(F.lit(1)).alias("total"))
    stack = ", ".join(f"{i}, {float(edges[i])!r}D, {float(edges[i + 1])!r}D, c{i}" for i in range(n_bins))
    rows = counts.selectExpr(f"stack({n_bins}, {stack}) AS (bin, lo, hi, count)", "total")
    return rows.select(F.col("bin").cast("int").alias("bin"), "lo", "hi", F.col("count").cast("bigint").alias("count"),
                       (F.col("count") / F.col("total") * 100.0).alias("pct"))


def listen_counts_for_ids(ids: DataFrame, plays: DataFrame, key: str = "item_id") -> DataFrame:
    """(id, listen_count): every listed ID with its total plays, 0 when unplayed.

    IDs not in the list are ignored; a repeated listed ID keeps each copy.
    """
    totals = plays.groupBy(F.col(key).alias("id")).agg(F.sum("play_count").cast("bigint").alias("_t"))
    return ids.select("id").join(totals, "id", "left").select(
        "id", F.coalesce("_t", F.lit(0)).cast("bigint").alias("listen_count"))


def scan_counts_histogram(counts: DataFrame) -> DataFrame:
    """Histogram over a one-column file of play counts (``play_count``)."""
    return play_histogram(counts, PLAY_HISTOGRAM_EDGES, "play_count")

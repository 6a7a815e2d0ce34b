"""Popularity coverage: how much of the listening the top songs account for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CURVE_POINTS = tuple(range(5, 201, 5))   # top-n sizes of the reference's curve


def _top_by_occurrence(plays: DataFrame, max_n: int) -> DataFrame:
    """(subset, rank, item_id): the max_n songs with most rows per subset; ties by id."""
    occ = plays.groupBy("subset", "item_id").agg(F.count(F.lit(1)).alias("_occ"))
    w = Window.partitionBy("subset").orderBy(F.col("_occ").desc(), F.col("item_id"))
    # rank <= max_n on a ranked window: planned as a WindowGroupLimit (partial top-k).
    return occ.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_n) \
              .select("subset", "rank", "item_id")


def popularity_curve_subsets(plays: DataFrame, points: Sequence[int] = CURVE_POINTS) -> DataFrame:
    """(subset, n, triplet_pct, user_pct) for each top-n size in ``points``.

    triplet_pct: % of the subset's rows on its top-n songs by occurrence;
    user_pct: % of the subset's users who played at least one of them. One
    pass: each row meets the small rank table once, users count at their
    best (smallest) rank, then running sums over at most max(points) ranks.
    """
    max_n = max(points)
    top = _top_by_occurrence(plays, max_n)
    on_top = plays.select("subset", "user_id", "item_id").join(top, ["subset", "item_id"])
    rows_per_rank = on_top.groupBy("subset", "rank").agg(F.count(F.lit(1)).alias("_rows"))
    best = on_top.groupBy("subset", "user_id").agg(F.min("rank").alias("rank"))
    users_per_rank = best.groupBy("subset", "rank").agg(F.count(F.lit(1)).alias("_users"))
    totals = plays.groupBy("subset").agg(F.count(F.lit(1)).alias("_all_rows"),
                                         F.count_distinct("user_id").alias("_all_users"))
    # Ranks, per-rank counts and the subset totals stacked in one small table
    # (at most max_n + 1 rows per subset) and combined by windows on the
    # subset: no join, so nothing degenerates into a keyless join when there is
    # a single subset.
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    stacked = (top.select("subset", "rank", zero.alias("_rows"), zero.alias("_users"),
                          none.alias("_all_rows"), none.alias("_all_users"))
               .unionByName(rows_per_rank.select("subset", "rank", "_rows", zero.alias("_users"),
                                                 none.alias("_all_rows"), none.alias("_all_users")))
               .unionByName(users_per_rank.select("subset", "rank", zero.alias("_rows"), "_users",
                                                  none.alias("_all_rows"), none.alias("_all_users")))
               .unionByName(totals.select("subset", F.lit(None).cast("int").alias("rank"), zero.alias("_rows"),
                                          zero.alias("_users"), "_all_rows", "_all_users")))
    per_rank = stacked.groupBy("subset", "rank").agg(
        F.sum("_rows").alias("_rows"), F.sum("_users").alias("_users"),
        F.max("_all_rows").alias("_all_rows"), F.max("_all_users").alias("_all_users"))
    running = Window.partitionBy("subset").orderBy(F.col("rank").asc_nulls_first()) \
                    .rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("subset")
    curve = per_rank.select("subset", "rank",
                            F.sum("_rows").over(running).alias("_cr"),
                            F.sum("_users").over(running).alias("_cu"),
                            F.max("_all_rows").over(whole).alias("_all_rows"),
                            F.max("_all_users").over(whole).alias("_all_users"))
    return curve.filter(F.col("rank").isin(list(points))).select(
        "subset", F.col("rank").cast("int").alias("n"),
        (F.col("_cr") / F.col("_all_rows") * 100.0).alias("triplet_pct"),
        (F.col("_cu") / F.col("_all_users") * 100.0).alias("user_pct"))


def popularity_curve(plays: DataFrame, points: Sequence[int] = CURVE_POINTS) -> DataFrame:
    """(n, triplet_pct, user_pct) over all plays."""
    return popularity_curve_subsets(plays.withColumn("subset", F.lit("all")), points).drop("subset")


def popularity_statistics(plays: DataFrame, first_n: int) -> DataFrame:
    """One row (n, triplet_pct, user_pct) for the top ``first_n`` songs."""
    return popularity_curve(plays, [first_n])


def log_occurrence_histogram(item_stats: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, count): ln(occurrence) in ``bins`` equal bins from min to max,
    the last bin closed. Min and max are two scalars of one aggregate."""
    x = F.log(F.col("occurrence").cast("double"))
    mm = item_stats.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    mn, mx = float(mm["mn"]), float(mm["mx"])
    width = (mx - mn) if mx > mn else 1.0
    idx = F.least(F.floor((x - F.lit(mn)) * F.lit(bins / width)), F.lit(bins - 1)).cast("int")
    counts = item_stats.select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = item_stats.sparkSession
    edges = spark.createDataFrame([(b, mn + b * width / bins, mn + (b + 1) * width / bins) for b in range(bins)],
                                  "bin INT, lo DOUBLE, hi DOUBLE")
    return edges.join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def occurrence_vs_total(stats: DataFrame) -> DataFrame:
    """(id, occurrence, total_play) pairs behind the scatter plots."""
    return stats.select("id", "occurrence", "total_play")

"""Damped play weights, item-item cosine similarity and nearest-neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.columns import log1p_weight, log_weight
from playlens.operators.sparse_product import sparse_product


def log_weights(plays: DataFrame, row: str = "user_id", item: str = "item_id",
                value: str = "play_count") -> DataFrame:
    """(row, item_id, w = ln(play) + 1) for plain users; non-positive counts drop out."""
    return plays.select(F.col(row).alias("row"), F.col(item).alias("item_id"),
                        log_weight(value).alias("w")).filter(F.col("w").isNotNull())


def log1p_weights(virtual: DataFrame, row: str = "group_id", item: str = "item_id",
                  value: str = "score") -> DataFrame:
    """(row, item_id, w = ln(score + 1)) for virtual users; zero scores drop out."""
    return virtual.select(F.col(row).alias("row"), F.col(item).alias("item_id"),
                          log1p_weight(value).alias("w")).filter(F.col("w") != 0)


def _normalised_columns(weights: DataFrame) -> DataFrame:
    """(r = item, t = row, x = w / |item column|); zero-norm items drop out."""
    norms = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return (weights.join(norms, "item_id").filter(F.col("_norm") > 0)
                   .select(F.col("item_id").alias("r"), F.col("row").alias("t"),
                           (F.col("w") / F.col("_norm")).alias("x")))


def item_cosine(weights: DataFrame, **tiling) -> DataFrame:
    """(item_i, item_j, sim): every nonzero cosine between item columns, i != j."""
    cols = _normalised_columns(weights)
    cells = sparse_product(cols, **tiling)
    return cells.filter(F.col("r") != F.col("q")).select(
        F.col("r").alias("item_i"), F.col("q").alias("item_j"), F.col("v").alias("sim"))


def k_similar_items(weights: DataFrame, k: int = 50, **tiling) -> DataFrame:
    """(item_i, item_j, sim, rank): the k most similar other items of each item.

    Ranked by similarity (rounded to 9 places) descending, then item_j; only
    positive similarities are listed, so an item with fewer than k co-played
    items has a shorter list (the reference pads with zero-similarity items,
    which add nothing to kNN scores).
    """
    cols = _normalised_columns(weights)
    top = sparse_product(cols, k=k, exclude="self", **tiling)
    return top.select(F.col("r").alias("item_i"), F.col("q").alias("item_j"),
                      F.col("v").alias("sim"), F.col("rank").cast("int").alias("rank"))


def similar_items(neighbours: DataFrame, items: DataFrame, k: int = 30) -> DataFrame:
    """The first k neighbours of each of ``items`` (item_id) from a neighbour table."""
    asked = items.select(F.col("item_id").alias("item_i"))
    return neighbours.filter(F.col("rank") <= k).join(asked, "item_i", "left_semi").select(*neighbours.columns)

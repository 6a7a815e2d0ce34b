"""User groups and virtual users.

Groups: users are put in a seeded pseudo-random order (md5 of seed:user),
numbered with the two-pass global index, and cut into groups of g; every user
is in exactly one group and only the last group may be smaller.

Virtual users: the members' plays of one item are folded into one score by a
named aggregate (see ``functions.aggregates``). Everything stays in long form
(group_id, item_id, score); the wide group x item table is a pivot on request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.aggregates import group_aggregate
from playlens.functions.columns import seeded_key
from playlens.functions.numbering import global_index


def group_users(users: DataFrame, g_size: int = 4, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(group_id BIGINT, user_id): consecutive runs of ``g_size`` users in seeded order."""
    if g_size < 1:
        raise ValueError("g_size must be >= 1")
    ids = users.select(F.col(id_col).alias("user_id")).filter(F.col("user_id").isNotNull()).distinct()
    keyed = ids.withColumn("_key", seeded_key(seed, "user_id"))
    numbered = global_index(keyed, ["_key", "user_id"], "_pos")
    return numbered.select((F.col("_pos") / F.lit(g_size)).cast("bigint").alias("group_id"), "user_id")


def form_groups(split_plays: DataFrame, membership: DataFrame) -> DataFrame:
    """(group_id, split, user_id, item_id, play_count): members' plays per group.

    ``split_plays`` carries a ``split`` column (train / test). Unplayed cells are
    simply absent (the zeros of the reference's aligned frames).
    """
    return split_plays.join(membership.select("group_id", "user_id"), "user_id").select(
        "group_id", "split", "user_id", "item_id", "play_count")


def group_weights(membership: DataFrame, user_stats: DataFrame) -> DataFrame:
    """(group_id, user_id, weight = 1 / user's mean play)."""
    means = user_stats.select(F.col("id").alias("user_id"), F.col("mean").cast("double").alias("_mean"))
    return membership.join(means, "user_id").select(
        "group_id", "user_id", (F.lit(1.0) / F.col("_mean")).alias("weight"))


def group_aggregate_scores(group_plays: DataFrame, agg: str = "avg",
                           weights: DataFrame | None = None) -> DataFrame:
    """(group_id, item_id, score): one virtual-user score per (group, item).

    Items no member played do not appear (score 0 in the reference's wide form).
    """
    rows = group_plays
    if agg == "weighted_avg":
        if weights is None:
            raise ValueError("weighted_avg needs group weights")
        rows = rows.join(weights.select("group_id", "user_id", "weight"), ["group_id", "user_id"])
    return (rows.groupBy("group_id", "item_id")
                .agg(group_aggregate(agg).alias("score"))
                .select("group_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score")))


def virtual_users(group_plays: DataFrame, agg: str = "avg", weights: DataFrame | None = None,
                  split: str | None = None) -> DataFrame:
    """Long virtual users for one split (or all rows when ``split`` is None)."""
    rows = group_plays if split is None else group_plays.filter(F.col("split") == split)
    return group_aggregate_scores(rows, agg, weights)


def virtual_users_wide(virtual: DataFrame, items: Sequence, names: Sequence[str] | None = None) -> DataFrame:
    """group x item table for an explicit, bounded list of items, zeros filled.

    Every group of ``virtual`` gets a row. The column list must be given (and
    optionally renamed): a pivot over every item would first gather the whole
    item set on the driver and build one column per item.
    """
    wide = (virtual.groupBy("group_id").pivot("item_id", list(items))
                   .agg(F.first("score")).na.fill(0.0))
    if names is not None:
        wide = wide.select("group_id", *[F.col(f"`{i}`").alias(n) for i, n in zip(items, names)])
    return wide


def virtual_user_blocks(virtual: DataFrame, item_index: DataFrame, size: int = 1024) -> DataFrame:
    """(group_id, block, scores): the group x item table over all items, as blocks.

    ``item_index`` (id, idx) gives each item its position; block b holds the
    positions b * size to b * size + size - 1, zeros filled (also past the last
    item). Blocks in which a group has no row are not made.
    """
    at = item_index.select(F.col("id").alias("item_id"), F.col("idx").alias("_idx"))
    cells = (virtual.join(at, "item_id")
                    .select("group_id", F.expr(f"cast(_idx div {size} as int)").alias("block"),
                            F.struct((F.col("_idx") % size).cast("int").alias("p"), F.col("score").cast("double").alias("s")).alias("cell")))
    rows = cells.groupBy("group_id", "block").agg(F.array_sort(F.collect_list("cell")).alias("c"))
    # each score after the zeros that lie between it and the one before
    filled = ("flatten(transform(c, (x, i) -> concat(array_repeat(0D, x.p - if(i = 0, -1, c[i - 1].p) - 1), array(x.s))))")
    return rows.select("group_id", "block", F.expr(
        f"concat({filled}, array_repeat(0D, {size} - 1 - element_at(c, -1).p))").alias("scores"))


def virtual_train_test(group_plays: DataFrame, user_stats: DataFrame, membership: DataFrame,
                       agg: str = "normalized_avg") -> tuple[DataFrame, DataFrame]:
    """Group weights + virtual train and test users in one call."""
    weights = group_weights(membership, user_stats) if agg == "weighted_avg" else None
    return (virtual_users(group_plays, agg, weights, "train"),
            virtual_users(group_plays, agg, weights, "test"))

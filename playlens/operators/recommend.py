"""Recommenders: popularity, seeded random, item kNN and implicit ALS.

Lists come out long, one row per (entity, rank, item_id), rank 1-based.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.columns import seeded_key
from playlens.functions.numbering import global_index
from playlens.operators.sparse_product import TIE_DIGITS, sparse_product, top_k_per_row
from playlens.session import written

POPULARITY_COLUMNS = {"tot": "total_play", "occ": "occurrence", "mean": "mean"}


def top_items(item_stats: DataFrame, by: str = "occ", n: int = 20) -> DataFrame:
    """(rank, item_id): the n items with the largest total / occurrence / mean; ties by id."""
    if by not in POPULARITY_COLUMNS:
        raise ValueError(f"by must be one of {sorted(POPULARITY_COLUMNS)}")
    col = POPULARITY_COLUMNS[by]
    top = item_stats.orderBy(F.col(col).desc(), F.col("id")).limit(n)
    return _numbered(top.select(F.col(col).alias("_v"), F.col("id").alias("item_id")),
                     [F.col("_v").desc(), F.col("item_id")])


def _numbered(bounded: DataFrame, order) -> DataFrame:
    # ``bounded`` has at most n rows (a limit), so an unpartitioned window is fine.
    return bounded.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "item_id")


def _same_list_for_all(entities: DataFrame, ranked: DataFrame, entity_col: str) -> DataFrame:
    """The same bounded list (at most n rows) for every entity.

    The n item ids are fetched to the driver (n is the list length, a bounded
    parameter) and attached as a literal array, so no join without a key is
    planned.
    """
    item_type = ranked.schema["item_id"].dataType
    items = [r["item_id"] for r in ranked.orderBy("rank").collect()]
    arr = F.array(*[F.lit(i).cast(item_type) for i in items]) if items else F.array().cast(
        f"array<{item_type.simpleString()}>")
    return entities.select(F.col(entity_col), F.posexplode(arr).alias("_p", "item_id")).select(
        entity_col, (F.col("_p") + 1).cast("int").alias("rank"), "item_id")


def recommend_popular(entities: DataFrame, item_stats: DataFrame, by: str = "occ", n: int = 20,
                      entity_col: str = "entity") -> DataFrame:
    """Same top-n list for each entity; played items are not removed."""
    return _same_list_for_all(entities, top_items(item_stats, by, n), entity_col)


def random_items(items: DataFrame, n: int = 20, seed: int = 42, frac: float = 0.2,
                 id_col: str = "id") -> DataFrame:
    """(rank, item_id): a seeded random 20% of the items, first n of it."""
    keyed = items.select(F.col(id_col).alias("item_id")).distinct().withColumn("_k", seeded_key(seed, "item_id"))
    total = keyed.count()
    take = min(n, int(round(frac * total)))
    top = keyed.orderBy("_k", "item_id").limit(take)
    return _numbered(top, [F.col("_k"), F.col("item_id")])


def recommend_random(entities: DataFrame, items: DataFrame, n: int = 20, seed: int = 42,
                     frac: float = 0.2, entity_col: str = "entity") -> DataFrame:
    return _same_list_for_all(entities, random_items(items, n, seed, frac), entity_col)


def _scaled_neighbours(neighbours: DataFrame) -> DataFrame:
    """(q = item, t = neighbour, y = sim / sum of the item's neighbour sims)."""
    # a window: ``neighbours`` may be a whole product, which a join with its own sums would make twice
    den = F.sum("sim").over(Window.partitionBy("item_i"))
    return neighbours.filter(F.col("item_i").isNotNull()).withColumn("_den", den).filter(F.col("_den") > 0).select(
        F.col("item_i").alias("q"), F.col("item_j").alias("t"), (F.col("sim") / F.col("_den")).alias("y"))


def predict_knn(weights: DataFrame, neighbours: DataFrame, **tiling) -> DataFrame:
    """(row, item_id, score) for every unplayed item with a played neighbour.

    score = sum(sim * w over the item's neighbours) / sum(sim over all its
    neighbours). Played items are left out (the reference scores them 0).
    """
    x = weights.select(F.col("row").alias("r"), F.col("item_id").alias("t"), F.col("w").alias("x"))
    # played cells are left out in the product, so that no cell is shuffled
    cells = sparse_product(x, _scaled_neighbours(neighbours), exclude="x_support", **tiling)
    unweighted = weights.filter(F.col("w").isNull() | (F.col("w") == 0)).select(F.col("row").alias("r"), F.col("item_id").alias("q"))
    if unweighted.take(1):  # played, but no entry of the product
        cells = cells.join(unweighted, ["r", "q"], "left_anti")
    return cells.filter(F.col("v") > 0).select(
        F.col("r").alias("row"), F.col("q").alias("item_id"), F.col("v").alias("score"))


def recommend_knn(weights: DataFrame, neighbours: DataFrame, n: int = 20, pad: bool = False,
                  items: DataFrame | None = None, **tiling) -> DataFrame:
    """(row, rank, item_id, score): the n best unplayed items per row by kNN score.

    Only positive scores are listed, unless ``pad`` asks for full lists: they go on
    with unplayed items of score 0 by ascending id, out of ``items`` (item_id; by
    default the items of ``weights``). Every row of ``weights`` then has n items, or
    all its unplayed ones.
    """
    if pad:
        every = items if items is not None else weights
        found = recommend_knn(weights, neighbours, n, **tiling)
        return pad_lists(found, weights.select("row", "item_id"), every.select("item_id").distinct(), n)
    x = weights.select(F.col("row").alias("r"), F.col("item_id").alias("t"), F.col("w").alias("x"))
    top = sparse_product(x, _scaled_neighbours(neighbours), k=n, exclude="x_support", **tiling)
    return top.select(F.col("r").alias("row"), F.col("rank").cast("int").alias("rank"),
                      F.col("q").alias("item_id"), F.col("v").alias("score"))


#: Item positions of one block of ``pad_lists``: what a window task numbers at most.
PAD_BLOCK = 1 << 16
#: Item positions that are sent to all tasks; where rows need more, they are joined by a shuffle.
PAD_SENT = 1 << 20


def pad_lists(lists: DataFrame, played: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``lists`` (row, rank, item_id, score) filled up to ``n`` items for each row of
    ``played`` (row, item_id), with items of score 0 that the row neither lists nor
    played, by ascending id.

    No row meets every item: a row's taken items (listed or played) are numbered by
    their position among all items. The taken item at position s with i taken ones
    before it has s - i free positions before it, so the free position number j is
    j + (taken items with at most j free ones before them), and only counts of these
    by j < n are kept for a row. A row's taken items are numbered in blocks of
    positions, each after the number in the blocks before it, so that a row with very
    many plays is not numbered in one task.

    The first n free positions of a row lie among the first n + (its taken items), so only
    items and taken items up to n + (the most that a row has) are placed at all; as long as
    these are few they are sent to the tasks, and neither plays nor lists are shuffled.
    """
    lists = written(lists.select("row", "rank", "item_id", "score"), "lists")  # a whole product, read four times
    taken = played.select("row", "item_id").unionByName(lists.select("row", "item_id"))
    most = taken.groupBy("row").count().agg(F.max("count")).first()[0] or 0
    position = global_index(items, ["item_id"], "s").filter(F.col("s") < n + most)
    if n + most <= PAD_SENT:
        position = F.broadcast(position)
    placed = taken.join(position, "item_id").select("row", "s", F.expr(f"s div {PAD_BLOCK}").alias("b")).distinct()
    before = Window.partitionBy("row").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (placed.groupBy("row", "b").agg(F.count(F.lit(1)).alias("c"))
                    .select("row", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o")))
    inside = Window.partitionBy("row", "b").orderBy("s")
    free = F.col("s") - F.col("o") - (F.row_number().over(inside) - 1)
    per = placed.join(blocks, ["row", "b"]).select("row", free.alias("d")).filter(F.col("d") < n)
    counts = (per.groupBy("row", "d").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy("row").agg(F.collect_list(F.struct("d", "c")).alias("ds")))  # at most n entries
    have = lists.groupBy("row").agg(F.count(F.lit(1)).alias("h"))
    gaps = (played.select("row").distinct().join(have, "row", "left").join(counts, "row", "left")
                  .withColumn("h", F.coalesce("h", F.lit(0))).filter(F.col("h") < n)
                  .select("row", "h", "ds", F.explode(F.sequence(F.lit(0), (F.lit(n - 1) - F.col("h")).cast("int"))).alias("j")))
    shift = F.expr("aggregate(filter(coalesce(ds, array()), x -> x.d <= j), 0L, (a, x) -> a + x.c)")
    added = (gaps.select("row", (F.col("h") + F.col("j") + 1).cast("int").alias("rank"), (F.col("j") + shift).alias("s"))
                 .join(position, "s").select("row", "rank", "item_id", F.lit(0.0).alias("score")))
    return lists.select("row", "rank", "item_id", "score").unionByName(added)


#: Ratings of one ALS block by which a fit is cut into as many blocks as there are cores,
#: and what a task of an iteration holds at most (24 bytes each).
BLOCK_RATINGS = 200_000
MOST_BLOCK_RATINGS = 4_000_000


def als_blocks(ratings: DataFrame) -> int:
    """User and item blocks for ALS, by the number of ratings (one scalar): a small fit
    isn't cut into tasks that wait for each other, a large one has bounded blocks. Every
    iteration sends a factor to each block that uses it, so there are no more blocks than
    cores until the blocks would be too large."""
    n = ratings.count()
    cores = ratings.sparkSession.sparkContext.defaultParallelism
    return max(1, min(math.ceil(n / BLOCK_RATINGS), cores), math.ceil(n / MOST_BLOCK_RATINGS))


def train_als(ratings: DataFrame, rank: int = 10, reg: float = 0.1, alpha: float = 0.01,
              max_iter: int = 10, seed: int = 10, blocks: int | None = None):
    """Implicit-feedback ALS on (row INT, item INT, rating) with MLlib."""
    from pyspark.ml.recommendation import ALS
    parts = blocks or als_blocks(ratings)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True, seed=seed,
              userCol="row", itemCol="item", ratingCol="rating", numUserBlocks=parts,
              numItemBlocks=parts, coldStartStrategy="drop", checkpointInterval=5)
    return als.fit(ratings.select(F.col("row").cast("int").alias("row"),
                                  F.col("item").cast("int").alias("item"),
                                  F.col("rating").cast("float").alias("rating")))


#: Scores a task holds at a time: a tile is worked off by some users after the others.
PASS_CELLS = 1 << 21


def _tile_top_n(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """Scores of one (user block, item block) tile and each user's n best items in it,
    without those ranked under ``nth``, the score of n better ones where it is known."""
    users = pdf[pdf["side"] == 0]
    items = pdf[pdf["side"] == 1]
    none = pd.DataFrame({"r": pd.Series([], dtype="int64"), "q": pd.Series([], dtype="int64"),
                         "v": pd.Series([], dtype="float64")})
    if users.empty or items.empty:
        return none
    u = np.stack(users["features"].to_numpy()).astype(np.float64)
    v = np.stack(items["features"].to_numpy()).astype(np.float64)
    uid = users["a"].to_numpy(np.int64)
    iid = items["a"].to_numpy(np.int64)
    known = users["nth"].to_numpy(np.float64) if "nth" in users else np.full(len(uid), np.nan)
    least = np.where(np.isnan(known), -np.inf, np.rint(known * 10.0 ** TIE_DIGITS))
    k = min(n, len(iid))
    step = max(1, PASS_CELLS // len(iid))
    parts = []
    for lo in range(0, len(uid), step):
        scores = u[lo:lo + step] @ v.T
        # Everything at or above each row's k-th best rank key (ties kept, cut later).
        keys = np.rint(scores * 10.0 ** TIE_DIGITS)
        kth = np.partition(keys, len(iid) - k, axis=1)[:, len(iid) - k]
        rows, cols = np.nonzero(keys >= np.maximum(kth, least[lo:lo + step])[:, None])
        if not rows.size:
            continue
        vals = scores[rows, cols]
        order = np.lexsort((iid[cols], -keys[rows, cols], rows))
        rows, cols, vals = rows[order], cols[order], vals[order]
        first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        pos = np.arange(rows.size) - np.repeat(first, np.diff(np.r_[first, rows.size]))
        keep = pos < k
        parts.append(pd.DataFrame({"r": uid[lo + rows[keep]], "q": iid[cols[keep]], "v": vals[keep]}))
    return pd.concat(parts, ignore_index=True) if parts else none


def _norm(col: str) -> Column:
    return F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


#: Steps of item norms that a user's bound is compared with (a literal of at most so many numbers).
BOUND_STEPS = 1024


def blocks_needed(users: DataFrame, first: DataFrame, block_norms: list[float], n: int) -> DataFrame:
    """``users`` (a, norm, features) with ``need``: how many of the blocks 1, 2, ... can
    still hold one of a user's n best items, and ``nth``: the user's n-th score so far.

    ``first`` (r, v, rank) are the lists from block 0, ``block_norms`` the largest norm of
    each block, descending. By Cauchy-Schwarz no item of a block scores above the user's
    norm times the block's largest norm; where that is under the user's n-th score, the
    block and all after it are left out. The bound allows for the rounding of scores and ranks.
    """
    rest = block_norms[1:]
    step = math.ceil(len(rest) / BOUND_STEPS)
    bounds = F.array(*[F.lit(float(b)) for b in rest[::step]])
    last = first.filter(F.col("rank") == n).select(F.col("r").alias("a"), F.col("v").alias("nth"))
    reach = F.size(F.filter(bounds, lambda b: b * F.col("norm") * F.lit(1 + 1e-9) + F.lit(2 * 10.0 ** -TIE_DIGITS) >= F.col("nth")))
    need = F.when(F.col("nth").isNull(), F.lit(len(rest))).otherwise(F.least(reach * F.lit(step), F.lit(len(rest))))
    return users.join(last, "a", "left").select("a", "norm", "features", need.cast("long").alias("need"), "nth")


#: Sides of square tiles of factors in units of the root of ``max_cells``.
WIDE = 4


def top_n_from_factors(user_factors: DataFrame, item_factors: DataFrame, n: int = 20,
                       max_cells: int = 1 << 24) -> DataFrame:
    """(r, q, v, rank): the n best items per user by factor dot product.

    Users and items are cut into blocks; one task per tile (user block, item block)
    multiplies its two factor blocks, PASS_CELLS scores at a time, and keeps the n best
    per user. A tile has at most ``max_cells`` scores, or its square blocks sides of up to
    WIDE times the root of that. No keyless join.

    With one item block its lists are final. Otherwise items are put into square blocks
    by falling norm. Every user meets the block of the largest norms first, and then
    only the blocks that can still hold one of its n best (``blocks_needed``), which hand
    on nothing under the user's n-th score of the first. Users are
    put into blocks by that number, so that an item block is copied only to user blocks
    that ask for it. A ranked window (WindowGroupLimit) takes the final n. The driver
    holds one norm per item block (items / 16,384 numbers by default).
    """
    spark = user_factors.sparkSession
    n_users, n_items = user_factors.count(), item_factors.count()
    # All items are one block when a block of at least 256 users still fits
    # ``max_cells`` scores; otherwise tiles are square, which copies least.
    square = n_items > max(1, max_cells // 256)
    per_block_items = max(1, math.isqrt(max_cells)) * WIDE if square else max(n_items, 1)
    nb_i = max(1, math.ceil(n_items / per_block_items))
    users_per_block = per_block_items if square else max(1, max_cells // per_block_items)
    nb_u = max(1, math.ceil(n_users / users_per_block))
    if nb_i == 1:
        nb_u = max(nb_u, spark.sparkContext.defaultParallelism)
    nb_u = max(1, min(nb_u, n_users))
    users = user_factors.select(F.col("id").cast("long").alias("a"), "features")
    items = item_factors.select(F.col("id").cast("long").alias("a"), "features")
    user_block = F.pmod(F.xxhash64("a"), F.lit(nb_u)).alias("ub")
    every_user_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb_u - 1).cast("long"))).alias("ub")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _tile_top_n(pdf, n)
        out["rank"] = (out.groupby("r").cumcount() + 1).astype("int32")
        return out

    def tiles(u: DataFrame, v: DataFrame) -> DataFrame:
        known = (F.col("nth") if "nth" in u.columns else F.lit(None)).cast("double").alias("nth")
        both = (u.select("ub", "ib", F.lit(0).alias("side"), "a", "features", known)
                 .unionByName(v.select("ub", "ib", F.lit(1).alias("side"), "a", "features", F.lit(None).cast("double").alias("nth"))))
        return both.groupBy("ub", "ib").applyInPandas(run, "r long, q long, v double, rank int")

    only = F.lit(0).cast("long").alias("ib")
    if nb_i == 1:
        return tiles(users.select("a", "features", user_block, only), items.select("a", "features", every_user_block, only))
    ordered = global_index(items.select("a", "features", (-_norm("features")).alias("fall")), ["fall", "a"], "idx")
    placed = ordered.select("a", "features", (-F.col("fall")).alias("norm"), F.expr(f"idx div {per_block_items}").alias("ib"))
    norms = [r["m"] for r in placed.groupBy("ib").agg(F.max("norm").alias("m")).orderBy("ib").collect()]
    first = tiles(users.select("a", "features", user_block, only),
                  placed.filter(F.col("ib") == 0).select("a", "features", every_user_block, "ib")).checkpoint(eager=True)
    asking = blocks_needed(users.withColumn("norm", _norm("features")), first, norms, n).filter(F.col("need") > 0)
    dealt = (global_index(asking.withColumn("fall", -F.col("need")), ["fall", "a"], "idx")
             .select("a", "features", "nth", F.expr(f"idx div {users_per_block}").alias("ub"),
                     F.explode(F.sequence(F.lit(1).cast("long"), F.col("need"))).alias("ib")))
    more = tiles(dealt, placed.join(dealt.select("ub", "ib").distinct(), "ib"))
    return top_k_per_row(first.drop("rank").unionByName(more.drop("rank")), n)


def recommend_als(model, n: int = 20) -> DataFrame:
    """(row, rank, item_id, score): top-n items per row; training items are not removed."""
    top = top_n_from_factors(model.userFactors, model.itemFactors, n)
    return top.select(F.col("r").alias("row"), F.col("rank").cast("int").alias("rank"),
                      F.col("q").alias("item_id"), F.col("v").alias("score"))

"""ALS evaluation, cross-validation and grid scans.

Where a fold and its factors fit one task, the ALS fits of a grid are the tasks of one job
(``als_grid``). Otherwise each fit is a distributed MLlib job: the fits of a grid run side by
side, write their lists into one table keyed by fold and parameter set, and one pass over
that table scores them all; the driver only walks the (small) grid.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.operators.als_grid import fits_one_task, hits_of_sets
from playlens.operators.metrics import N_LIST, evaluate_at, evaluate_hits, evaluate_same_lists, evaluate_sets
from playlens.operators.recommend import als_blocks, recommend_als, recommend_popular, top_items, train_als
from playlens.operators.stats import song_play_mean
from playlens.session import ensure_checkpoint_dir, scratch_path

#: Makes (entity, rank, item_id) lists from training cells and one parameter set.
Fit = Callable[[DataFrame, object], DataFrame]


def _ratings(train: DataFrame) -> DataFrame:
    """(row, item, rating) from (entity, item_id, score)."""
    return train.select(F.col("entity").alias("row"), F.col("item_id").alias("item"),
                        F.col("score").alias("rating")).filter(F.col("rating") != 0)


def evaluate_als(train: DataFrame, labels: DataFrame, rank: int = 10, reg: float = 0.1,
                 alpha: float = 0.01, ns: Sequence[int] = N_LIST, seed: int = 10) -> DataFrame:
    """(n, map, ndcg, f1, precision, recall, mpr): train once, cut the longest list."""
    model = train_als(_ratings(train), rank, reg, alpha, seed=seed)
    recs = recommend_als(model, max(ns)).withColumnRenamed("row", "entity")
    return evaluate_at(recs, labels, ns)


def als_lists(n: int = 200, seed: int = 10, blocks: int | None = None) -> Fit:
    """A fit for ``lists_of_sets``: implicit ALS with (rank, lambda, alpha)."""
    def fit(train: DataFrame, params: Sequence) -> DataFrame:
        rank, reg, alpha = params
        model = train_als(_ratings(train), rank, reg, alpha, seed=seed, blocks=blocks)
        return recommend_als(model, n).withColumnRenamed("row", "entity")
    return fit


class PopularLists:
    """A fit whose list is the same for every entity that has a training row: the
    popularity recommender by one of tot, occ, mean."""

    def __init__(self, n: int):
        self.n = n

    def statistics(self, train: DataFrame) -> DataFrame:
        return song_play_mean(train.select(F.col("entity").alias("user_id"), "item_id", F.col("score").alias("play_count")))

    def fold_statistics(self, stored: DataFrame, folds: Sequence[int]) -> DataFrame:
        """(id, total_<k>, occurrence_<k>) of the rows outside each fold k: the rows are
        summed once by item and fold, and these sums by item."""
        each = (stored.filter(F.col("item_id").isNotNull()).groupBy("item_id", "fold")
                      .agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_c")))
        outside = [(F.sum(F.when(F.col("fold") != k, F.col(c))).cast("bigint").alias(f"{name}_{k}"))
                   for k in folds for c, name in (("_s", "total"), ("_c", "occurrence"))]
        return each.groupBy(F.col("item_id").alias("id")).agg(*outside)

    def ranked(self, statistics: DataFrame, by: str) -> DataFrame:
        """(rank, item_id): the one list, at most n rows."""
        return top_items(statistics, by, self.n)

    def __call__(self, train: DataFrame, by: str) -> DataFrame:
        return recommend_popular(train.select("entity").distinct(), self.statistics(train), by, self.n)


def popular_lists(n: int = 200) -> PopularLists:
    """A fit for ``lists_of_sets`` and, by its one list a set, for ``cross_validate``."""
    return PopularLists(n)


def _same_list_scores(trains: Mapping[int, DataFrame], stored: DataFrame, grid: Sequence, fit: PopularLists) -> DataFrame:
    """Scores of every fold and set whose entities share one list: the driver holds n
    rows for each, the labels of a fold meet them, and no list is made for an entity."""
    spark = stored.sparkSession
    ensure_checkpoint_dir(spark)
    rows = []
    every_fold = fit.fold_statistics(stored, list(trains)).checkpoint(eager=True)  # once for all folds and sets
    for fold in trains:
        total, n = F.col(f"total_{fold}"), F.col(f"occurrence_{fold}")
        counted = every_fold.filter(n > 0).select("id", total.alias("total_play"), n.alias("occurrence"), (total / n).alias("mean"))
        rows += [(fold, pid, r["rank"], r["item_id"]) for pid, params in enumerate(grid) for r in fit.ranked(counted, params).collect()]
    item_type = stored.schema["item_id"].dataType.simpleString()
    ranked = spark.createDataFrame(rows, f"fold INT, param_id INT, rank INT, item_id {item_type}")
    every = stored.select("fold", "entity").distinct()
    folds = F.array(*[F.lit(k) for k in trains])
    # an entity has a list where it has a row of another fold
    entities = every.select("entity", F.explode(F.filter(folds, lambda k: k != F.col("fold"))).alias("fold")).distinct()
    return evaluate_same_lists(ranked, entities, stored.select("fold", "entity", "item_id"), ["fold", "param_id"])


def lists_of_sets(trains: Mapping[int, DataFrame], grid: Sequence, fit: Fit, parallel: int = 8) -> DataFrame:
    """(fold, param_id, entity, rank, item_id): the lists of every parameter set on
    every training table, in one written table.

    A fit is many short Spark jobs that wait for each other, so ``parallel`` fits run
    side by side and share the executors; a fit's lists go to a folder of their own.
    The driver holds no list and no score, whatever the grid."""
    spark = next(iter(trains.values())).sparkSession
    path = scratch_path(spark, "lists")

    def one(job: tuple[int, int]) -> None:
        fold, pid = job
        fit(trains[fold], grid[pid]).select("entity", "rank", "item_id").write.parquet(f"{path}/fold={fold}/param_id={pid}")

    # the dearest sets (the last of a grid in rising order) begin first
    jobs = [(fold, pid) for pid in reversed(range(len(grid))) for fold in trains]
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(jobs)))) as pool:
        list(pool.map(one, jobs))
    return spark.read.parquet(path)


def cross_validate(folded: DataFrame, grid: Sequence, n: int = 200, cv: int | None = None, seed: int = 10,
                   fit: Fit | None = None, parallel: int = 8) -> DataFrame:
    """(fold, param_id, map, mpr): one score row per fold and parameter set.

    ``folded``: (entity, item_id, score, fold). Fold k is the test set and the
    others train; labels are the test items. ``fit`` makes the lists of one set
    (implicit ALS by default, a fit a task where that is small enough); where a set has one
    list for all entities, the labels meet that list. All lists are scored in one pass,
    keyed by fold and set, against the labels of their fold.
    """
    spark = folded.sparkSession
    # Every fit reads the fold table again: written once, by fold, so a fit reads
    # the folds it trains on and nothing else.
    path = scratch_path(spark, "folds")
    folded.select("entity", "item_id", "score", "fold").write.partitionBy("fold").parquet(path)
    stored = spark.read.parquet(path)
    folds = cv if cv is not None else stored.agg(F.max("fold")).first()[0] + 1
    trains = {k: stored.filter(F.col("fold") != k) for k in range(folds)}
    if fit is None and fits_one_task(stored, grid):
        held = sorted(r["fold"] for r in stored.select("fold").filter(F.col("fold").isNotNull()).distinct().collect())
        cells = {k: stored.filter(F.col("fold") == k) for k in held}
        uses = {k: ([c for c in cells if c != k], [k] if k in cells else []) for k in trains}
        hits = hits_of_sets(uses, cells, {k: _ratings(t) for k, t in trains.items()}, grid, n, seed, als_blocks(stored), parallel)
        return evaluate_hits(hits, stored.select("fold", "entity", "item_id"), ["fold", "param_id"]).select("fold", "param_id", "map", "mpr")
    fit = fit or als_lists(n, seed, als_blocks(stored))
    if isinstance(fit, PopularLists):
        scores = _same_list_scores(trains, stored, grid, fit)
        return scores.select(F.col("fold").cast("int").alias("fold"), F.col("param_id").cast("int").alias("param_id"), "map", "mpr")
    lists = lists_of_sets(trains, grid, fit, parallel)
    scores = evaluate_sets(lists, stored.select("fold", "entity", "item_id"), ["fold", "param_id"])
    return scores.select(F.col("fold").cast("int").alias("fold"), F.col("param_id").cast("int").alias("param_id"), "map", "mpr")


def cv_summary(scores: DataFrame) -> DataFrame:
    """(param_id, map_mean, map_min, map_max, mpr_mean, mpr_min, mpr_max)."""
    return scores.groupBy("param_id").agg(
        F.avg("map").alias("map_mean"), F.min("map").alias("map_min"), F.max("map").alias("map_max"),
        F.avg("mpr").alias("mpr_mean"), F.min("mpr").alias("mpr_min"), F.max("mpr").alias("mpr_max"))


def cv_best_params(summary: DataFrame, by: str = "mpr") -> DataFrame:
    """Best parameter set: lowest mean mPR, or highest mean MAP."""
    order = F.col("mpr_mean").asc() if by == "mpr" else F.col("map_mean").desc()
    return summary.orderBy(order, F.col("param_id")).limit(1)


def grid_scan(train: DataFrame, labels: DataFrame, grid: Sequence[tuple[int, float, float]],
              n: int = 200, seed: int = 10, parallel: int = 8) -> DataFrame:
    """(param_id, rank, reg, alpha, map, ndcg, f1, precision, recall, mpr) on one split,
    sorted by mPR ascending."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    train = train.select("entity", "item_id", "score").checkpoint(eager=True)
    cells = train.select("entity", "item_id").unionByName(labels.select("entity", "item_id"))
    if fits_one_task(cells, grid):
        both = {"train": train, "labels": labels.select("entity", "item_id", F.lit(0.0).alias("score"))}
        hits = hits_of_sets({0: (["train"], ["labels"])}, both, {0: _ratings(train)}, grid, n, seed, als_blocks(train), parallel)
        scores = evaluate_hits(hits.drop("fold"), labels, ["param_id"])
    else:
        lists = lists_of_sets({0: train}, grid, als_lists(n, seed, als_blocks(train)), parallel).drop("fold")
        scores = evaluate_sets(lists, labels, ["param_id"])
    sets = spark.createDataFrame([(i, int(r), float(lam), float(a)) for i, (r, lam, a) in enumerate(grid)],
                                 "param_id INT, rank INT, reg DOUBLE, alpha DOUBLE")
    return sets.join(scores, "param_id").select("param_id", "rank", "reg", "alpha", "map", "ndcg", "f1", "precision",
                                                "recall", "mpr").orderBy("mpr", "param_id")

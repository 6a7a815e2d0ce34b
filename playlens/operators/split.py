"""Per-user hold-out split and k-fold assignment.

Each user's rows are put in a fixed pseudo-random order by an md5 key of
(seed, user, item), ranked with the skew-safe ``rank_within`` (a user with more
than ``max_window_rows`` rows is spread over several window tasks), and cut by exact sizes:
round-half-even(frac * n) rows go to train, like pandas ``sample(frac)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.columns import seeded_key
from playlens.functions.numbering import MAX_WINDOW_ROWS, rank_within


def _ranked(plays: DataFrame, seed: int, max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    return rank_within(plays, ["user_id"], "_key", tie_cols=["item_id"], rank_col="_rank", size_col="_n",
                       max_window_rows=max_window_rows, key=seeded_key(seed, "user_id", "item_id"))


def split_train_test(plays: DataFrame, frac: float = 0.5, seed: int = 42,
                     max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """plays + ``split`` ('train' / 'test'); exactly bround(frac * n) train rows per user."""
    r = _ranked(plays, seed, max_window_rows)
    n_train = F.bround(F.lit(float(frac)) * F.col("_n"), 0)
    return r.withColumn("split", F.when(F.col("_rank") <= n_train, F.lit("train")).otherwise(F.lit("test"))) \
            .drop("_key", "_rank", "_n")


def fold_bounds(n: Column, cv: int) -> list[Column]:
    """Cumulative fold ends: fold i takes bround(remaining / (cv - i)) rows."""
    ends = []
    taken = F.lit(0.0)
    for i in range(cv):
        remaining = n.cast("double") - taken
        size = F.bround(remaining / F.lit(float(cv - i)), 0)
        taken = taken + size
        ends.append(taken)
    return ends


def cv_folds(plays: DataFrame, cv: int = 5, seed: int = 42,
             max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """plays + ``fold`` (0..cv-1); folds are disjoint and cover every row."""
    r = _ranked(plays, seed, max_window_rows)
    ends = fold_bounds(F.col("_n"), cv)
    fold = F.when(F.col("_rank") <= ends[0], F.lit(0))
    for i in range(1, cv):
        fold = fold.when(F.col("_rank") <= ends[i], F.lit(i))
    return r.withColumn("fold", fold.cast("int")).drop("_key", "_rank", "_n")


def cv_fold_train(folded: DataFrame, k: int) -> DataFrame:
    return folded.filter(F.col("fold") != k)


def cv_fold_test(folded: DataFrame, k: int) -> DataFrame:
    return folded.filter(F.col("fold") == k)

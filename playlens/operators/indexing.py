"""Dense ID indexes and ID replacement by joins (no driver-side dictionaries)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.numbering import global_index


def index_ids(ids: DataFrame, id_col: str = "id", idx_col: str = "idx") -> DataFrame:
    """(id, idx INT): 0..n-1 over the distinct IDs in ascending ID order.

    A repeated ID gets one index. The numbering is the two-pass global
    index (range partitions + per-partition offsets), never a one-task window.
    """
    distinct = ids.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct()
    return global_index(distinct, ["id"], idx_col).select("id", F.col(idx_col).cast("int").alias(idx_col))


def replace_ids(df: DataFrame, user_index: DataFrame, item_index: DataFrame,
                user_col: str = "user_id", item_col: str = "item_id", unknown: str = "drop") -> DataFrame:
    """Replace user and item IDs by their indexes (two keyed joins).

    unknown: ``drop`` removes rows with an ID missing from an index, ``keep``
    leaves a null index, ``error`` raises if any such row exists.
    """
    how = "inner" if unknown == "drop" else "left"
    ui = user_index.select(F.col("id").alias(user_col), F.col("idx").alias("_uidx"))
    ii = item_index.select(F.col("id").alias(item_col), F.col("idx").alias("_iidx"))
    out = df.join(ui, user_col, how).join(ii, item_col, how)
    cols = [F.col("_uidx").alias(user_col) if c == user_col else
            F.col("_iidx").alias(item_col) if c == item_col else F.col(c) for c in df.columns]
    out = out.select(*cols)
    if unknown == "error":
        missing = out.filter(F.col(user_col).isNull() | F.col(item_col).isNull()).limit(1).count()
        if missing:
            raise ValueError("some IDs are not in the index")
    elif unknown not in ("drop", "keep"):
        raise ValueError("unknown must be 'drop', 'keep' or 'error'")
    return out


def user_item_matrix(lines: DataFrame, user_index: DataFrame, item_index: DataFrame,
                     order_col: str = "line_no") -> DataFrame:
    """(row_idx, col_idx, value): the sparse user x song matrix in coordinate form.

    A repeated (user, song) keeps the value of its last line (``order_col``);
    absent cells are zero. Unknown IDs drop out.
    """
    last = (lines.groupBy("user_id", "item_id")
                 .agg(F.max_by("play_count", order_col).alias("play_count")))
    indexed = replace_ids(last, user_index, item_index, unknown="drop")
    return indexed.select(F.col("user_id").alias("row_idx"), F.col("item_id").alias("col_idx"),
                          F.col("play_count").alias("value"))

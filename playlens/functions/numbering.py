"""Skew-safe numbering helpers.

``global_index``: a dense 0..n-1 number over a total order, without a window
that has no partition (which would run in one task). Rows are range-partitioned
on the order, sorted inside each partition, materialised once by a reliable
checkpoint (so partition ids and positions are fixed, even if an executor is
lost and stages rerun), and each row gets ``offset(partition) + position``. The
only table that meets the driver-side broadcast is one row per partition.

``rank_within``: the 1-based rank of each row inside its group by a uniformly
distributed hex key (an md5), plus the group size. A window on the group alone
would put a hot group (say a user with a third of all rows) into one task, so
groups above a number of rows, and only these, are ranked on (group, salt) with the
salt taken from the key's leading hex digits, and counts per salt give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.session import ensure_checkpoint_dir

_POS_BITS = 33


def global_index(df: DataFrame, order_cols: Sequence[str], idx_col: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``idx_col`` following ``order_cols`` ascending.

    Rows should be unique in ``order_cols`` (ties get distinct but arbitrary
    numbers).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc() for c in order_cols]
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    placed = placed.withColumn("__gi_mid", F.monotonically_increasing_id())
    placed = (placed.withColumn("__gi_pid", F.shiftright("__gi_mid", _POS_BITS))
                    .withColumn("__gi_pos", F.col("__gi_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    # One row per partition: bounded by n, so the broadcast is safe.
    counts = placed.groupBy("__gi_pid").agg(F.count(F.lit(1)).alias("__gi_n"))
    before = Window.orderBy("__gi_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__gi_pid", F.coalesce(F.sum("__gi_n").over(before), F.lit(0)).alias("__gi_off"))
    return (placed.join(F.broadcast(offsets), "__gi_pid")
                  .withColumn(idx_col, F.col("__gi_off") + F.col("__gi_pos"))
                  .drop("__gi_mid", "__gi_pid", "__gi_pos", "__gi_off"))


#: Rows of one group that one window task ranks; larger groups are salted.
MAX_WINDOW_ROWS = 100_000
#: Salts of a group that one task numbers: 16**HEAD_DIGITS.
HEAD_DIGITS = 3


def rank_within(df: DataFrame, group_cols: Sequence[str], key_col: str,
                tie_cols: Sequence[str] = (), rank_col: str = "rank",
                size_col: str = "group_size", max_window_rows: int = MAX_WINDOW_ROWS, key: Column | None = None) -> DataFrame:
    """Add the 1-based rank of each row within ``group_cols`` by ``key_col`` (hex
    digits, evenly spread; then ``tie_cols``), and the group's row count.

    Groups of at most ``max_window_rows`` rows are ranked in one plain window. Only
    larger ones are salted, by as many leading digits of the key as bring a salt down
    to that size; the ranks of a salt go on from the rows of the salts before it,
    summed in two levels (within a head of the salt, and over heads). ``key`` is what
    ``key_col`` is made of where ``df`` has no such column: it is made after the rows are
    dealt to their groups, so that no key is shuffled.
    """
    groups = list(group_cols)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rw_n"))
    digits = F.least(F.ceil(F.log(F.col("__rw_n") / F.lit(max_window_rows)) / F.log(F.lit(16.0))), F.lit(12)).cast("int")
    hot = (sizes.filter((F.col("__rw_n") > max_window_rows) & F.expr(" AND ".join(f"`{g}` IS NOT NULL" for g in groups)))
                .withColumn("__rw_d", F.greatest(digits, F.lit(1))))
    order = [F.col(key_col), *[F.col(c) for c in tie_cols]]
    if not hot.take(1):
        whole = Window.partitionBy(*groups)
        if key is not None:
            df = df.repartition(*groups).withColumn(key_col, key)
        return (df.withColumn(rank_col, F.row_number().over(whole.orderBy(*order)).cast("bigint"))
                  .withColumn(size_col, F.count(F.lit(1)).over(whole)))
    if key is not None:
        df = df.withColumn(key_col, key)
    hot = hot.checkpoint(eager=True)
    salted = (df.join(hot, groups, "left")
                .withColumn("__rw_salt", F.coalesce(F.expr(f"substring(`{key_col}`, 1, `__rw_d`)"), F.lit(""))))
    part = Window.partitionBy(*groups, "__rw_salt")
    ranked = (salted.withColumn("__rw_r", F.row_number().over(part.orderBy(*order)))
                    .withColumn("__rw_c", F.count(F.lit(1)).over(part)))
    counts = (salted.filter(F.col("__rw_d").isNotNull()).groupBy(*groups, "__rw_d", "__rw_salt").agg(F.count(F.lit(1)).alias("__rw_k"))
                    .withColumn("__rw_head", F.expr(f"substring(`__rw_salt`, 1, greatest(`__rw_d` - {HEAD_DIGITS}, 0))")))
    before = Window.unboundedPreceding, -1
    inner = F.sum("__rw_k").over(Window.partitionBy(*groups, "__rw_head").orderBy("__rw_salt").rowsBetween(*before))
    heads = counts.groupBy(*groups, "__rw_head").agg(F.sum("__rw_k").alias("__rw_h"))
    above = F.sum("__rw_h").over(Window.partitionBy(*groups).orderBy("__rw_head").rowsBetween(*before))
    offsets = (counts.withColumn("__rw_i", inner).join(heads.withColumn("__rw_a", above).drop("__rw_h"), [*groups, "__rw_head"])
                     .select(*groups, "__rw_salt", (F.coalesce("__rw_i", F.lit(0)) + F.coalesce("__rw_a", F.lit(0))).alias("__rw_off")))
    return (ranked.join(offsets, [*groups, "__rw_salt"], "left")
                  .withColumn(rank_col, (F.coalesce("__rw_off", F.lit(0)) + F.col("__rw_r")).cast("bigint"))
                  .withColumn(size_col, F.coalesce("__rw_n", "__rw_c"))
                  .select(*df.columns, rank_col, size_col))

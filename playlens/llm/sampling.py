"""A bounded, reproducible sample per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, group: str, id_col: str, most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows per value of ``group`` (null is a value), those with the
    smallest hash of the id. Rows are thinned by the group's count first, so the
    ranking window of a group holds a few times ``most`` rows whatever its size."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    unit = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    thin = (rows.withColumn("__u", unit).join(sizes, F.col(group).eqNullSafe(F.col("__g")))
                .where(F.col("__u") * F.col("__n") <= F.lit(3.0 * most + 50)))
    w = Window.partitionBy("__g").orderBy("__u", F.col(id_col).cast("string"))
    return thin.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).select(*rows.columns)

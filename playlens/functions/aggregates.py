"""Group ("virtual user") aggregates chosen by name.

Each one folds the members' positive play counts of one item into one score.
Members who never played the item are simply absent from the long table, which
is the same as the zeros the aggregates skip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed names of the five aggregates (they must match the reference's names).
GROUP_AGGREGATES = ("avg", "normalized_avg", "least_misery", "median", "weighted_avg")


def group_aggregate(name: str, value: str = "play_count", weight: str = "weight") -> Column:
    """Aggregate column for ``name``; values <= 0 are ignored.

    avg             mean of the positive counts
    normalized_avg  exp(mean(ln(x) + 1)) = e * geometric mean
    least_misery    smallest positive count
    median          interpolated median of the positive counts
    weighted_avg    mean of the positive products x * weight (weight = 1/user mean);
                    not divided by the sum of the weights
    """
    x = F.col(value).cast("double")
    pos = F.when(x > 0, x)
    if name == "avg":
        return F.avg(pos)
    if name == "normalized_avg":
        return F.exp(F.avg(F.log(pos) + F.lit(1.0)))
    if name == "least_misery":
        return F.min(pos)
    if name == "median":
        return F.median(pos)
    if name == "weighted_avg":
        prod = x * F.col(weight).cast("double")
        return F.avg(F.when(prod > 0, prod))
    raise ValueError(f"unknown group aggregate {name!r}; expected one of {GROUP_AGGREGATES}")

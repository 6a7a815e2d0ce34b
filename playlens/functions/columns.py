"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *cols: str | Column) -> Column:
    """Deterministic pseudo-random sort key: md5 of ``seed:col1:col2...``.

    The same hex string comes out of DuckDB's ``md5(concat_ws(':', ...))``,
    so splits and groups can be checked against SQL. Replaces unseeded
    shuffles and ``sample`` calls.
    """
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def log_weight(play_count: str | Column = "play_count") -> Column:
    """Damped count for plain users: ln(play) + 1; non-positive counts are null."""
    c = F.col(play_count) if isinstance(play_count, str) else play_count
    return F.when(c > 0, F.log(c) + F.lit(1.0))


def log1p_weight(score: str | Column = "score") -> Column:
    """Damped score for virtual users: ln(score + 1); 0 stays 0."""
    c = F.col(score) if isinstance(score, str) else score
    return F.log1p(c.cast("double"))


def percent(part: str | Column, whole: str | Column) -> Column:
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return p.cast("double") / F.nullif(w.cast("double"), F.lit(0.0)) * F.lit(100.0)


def round_doubles(df, digits: int = 6):
    """Round every DOUBLE column (used where results are compared)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)

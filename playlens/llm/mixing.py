"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Raking scales the cells'
weights to one marginal after the other until they meet the targets: the share
of each source, of each language and of each topic. After each round a cell is
held to tokens / rate, so that no document would need a probability above one;
the next round moves the excess to other cells. A document is kept with
probability rate * weight / tokens of its cell, by a uniform number from its id
and a seed, so that a rerun keeps the same documents.

The documents are aggregated to cells before anything is shuffled; a source with
a third of all rows is one row per task and cell. Marginals are grouped sums
joined back to the cell table, which is cut from its lineage once a round.

Nulls: a null source, language or topic is the value ''. A null or empty text has
no tokens: its probability is that of its cell (rate in a cell without tokens).
Targets without documents are dropped and the others rescaled. Repeated rows are
kept or dropped together. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import prepare, stored

DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixSpec:
    rate: float = 0.5
    rounds: int = 12
    #: Target share of a value = its natural share to this power, rescaled.
    power: tuple[float, float, float] = (0.7, 0.7, 0.8)
    seed: str = "mix"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def genre(text: Column) -> Column:
    """A coarse topic by the form of a text; callers with a topic column use that."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("|"), "table").when(t.rlike(r"https?://|@"), "contact").when(F.length(t) < 600, "note")
             .when(F.length(t) < 4000, "article").otherwise("long"))


def _dims(docs: DataFrame, topic: Column) -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
            F.coalesce(topic.cast("string"), F.lit("")).alias("__topic")]


def smoothed_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, share): natural shares to a power, rescaled to sum to one."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    flat = sums.withColumn("s", F.pow(F.col("t").cast("double"), F.lit(power)))
    whole = flat.agg(F.sum("s")).first()[0] or 1.0
    return flat.select(dim, (F.col("s") / F.lit(whole)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], spec: MixSpec) -> DataFrame:
    """``cells`` (dims, tokens) with weight, raked to ``targets`` (dim, share)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cur = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, t in targets.items():
        have = cells.where("tokens > 0").select(d).distinct()
        t = t.join(have, d, "left_semi")
        whole = t.agg(F.sum("share")).first()[0] or 1.0
        goal = t.select(d, (F.col("share") / F.lit(whole) * F.lit(float(total))).alias(f"goal{d}"))
        cur = cur.join(goal, d, "left")
    # each cell carries the three goals it counts towards, so a step is one sum and one join
    carried = [f"__{x}" for x in DIMS] + ["tokens"] + [f"goal{d}" for d in targets]
    cur = stored(cur.select(*carried, "weight"), "goals")
    for _ in range(spec.rounds):
        for d in targets:
            sums = cur.groupBy(d).agg(F.sum("weight").alias("now"))
            factor = F.when(F.col("now") > 0, F.coalesce(F.col(f"goal{d}"), F.lit(0.0)) / F.col("now")).otherwise(F.lit(0.0))
            cur = cur.join(sums, d).select(*carried, (F.col("weight") * factor).alias("weight"))
        cur = cur.withColumn("weight", F.least("weight", F.col("tokens") / F.lit(spec.rate)))
        cur = stored(cur, "raked")
    return cur.select(*[f"__{x}" for x in DIMS], "tokens", "weight")


def probabilities(docs: DataFrame, spec: MixSpec | None = None, topic: Column | None = None,
                  targets: dict[str, DataFrame] | None = None, text_col: str = "text") -> DataFrame:
    """(dims, tokens, weight, probability) per cell of ``docs``."""
    spec = spec or MixSpec()
    prepare(docs.sparkSession)
    topic = topic if topic is not None else genre(F.col(text_col))
    per_doc = docs.select(*_dims(docs, topic), token_count(F.col(text_col)).alias("n"))
    cells = stored(per_doc.groupBy(*[f"__{d}" for d in DIMS]).agg(F.sum("n").alias("tokens")), "cells")
    goals = targets or {f"__{d}": smoothed_targets(cells, f"__{d}", p) for d, p in zip(DIMS, spec.power, strict=True)}
    raked = rake(cells, goals, spec)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(spec.rate) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(spec.rate))
    return stored(raked.withColumn("probability", p), "cell-probabilities")


def unit(id_col: str, seed: str) -> Column:
    """A uniform number in [0, 1) from the id (52 bits of md5)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def mix(docs: DataFrame, spec: MixSpec | None = None, topic: Column | None = None, targets: dict[str, DataFrame] | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with topic, n_tokens, probability and sampled (which
    replace extra columns of these names)."""
    spec = spec or MixSpec()
    kept = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "sampled")]
    topic = topic if topic is not None else genre(F.col(text_col))
    cells = probabilities(docs, spec, topic, targets, text_col).select(*[f"__{d}" for d in DIMS], "probability")
    # the caller's columns stand in one struct, where no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), *_dims(docs, topic), token_count(F.col(text_col)).alias("n_tokens"),
                       unit(id_col, spec.seed).alias("__u"))
    joined = rows.join(cells, [f"__{d}" for d in DIMS])
    return joined.select(*[F.col("rest").getField(c).alias(c) for c in kept], F.col("__topic").alias("topic"), "n_tokens", "probability",
                         (F.col("__u") < F.col("probability")).alias("sampled"))

"""Ranking metrics over long recommendation lists, in one DataFrame pass.

Inputs: ``recs`` (entity, rank, item_id) with rank 1-based and unique items per
entity, ``labels`` (entity, item_id). As in the reference, the entities are
those with a list; an entity without labels stays in with an empty label set.

    precision  mean over entities of hits / list length
    recall     mean over entities with labels of hits / labels
    f1         2 p r / (p + r) of the two means
    map        mean average precision (sum of hits-so-far / position over hits,
               divided by the number of labels; 0 without labels)
    ndcg@k     binary-gain DCG of the first k positions / ideal DCG of
               min(labels, k) hits; 0 without labels
    mpr        mean over entities of the mean percentile rank of their labels:
               (position - 1) / list length * 100, or 100 when not listed;
               0 for an entity without labels

Every list is bounded by its length n (at most a few hundred rows), so the
per-entity window on rank is small; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.session import written

METRIC_COLUMNS = ("map", "ndcg", "f1", "precision", "recall", "mpr")
N_LIST = (20, 50, 200)   # list lengths of the reference's sweeps


def _ideal_dcg(m: Column) -> Column:
    """sum_{i=1..m} 1 / ln(i + 1); m >= 1."""
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log(i.cast("double") + F.lit(1.0)))


def per_entity(recs: DataFrame, labels: DataFrame, k: int = 10,
               keys: Sequence[str] = ("entity",)) -> DataFrame:
    """One row per (keys...) with the per-entity parts of every metric."""
    keys = list(keys)
    # what labels are told apart by; the other keys (cut-off, parameter set) share them
    ent = [c for c in keys if c in labels.columns]
    lab = labels.select(*ent, "item_id").distinct()
    flagged = (recs.join(lab.withColumn("_hit", F.lit(1)), [*ent, "item_id"], "left")
                   .withColumn("_hit", F.coalesce("_hit", F.lit(0))))
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("_cum", F.sum("_hit").over(w))
    rank = F.col("rank").cast("double")
    per = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.sum("_hit").alias("hits"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_cum") / rank).otherwise(0.0)).alias("_ap"),
        F.sum(F.when((F.col("_hit") == 1) & (F.col("rank") <= k),
                     F.lit(1.0) / F.log(rank + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_hit") == 1, rank - 1.0).otherwise(0.0)).alias("_pos"))
    n_lab = lab.groupBy(*ent).agg(F.count(F.lit(1)).alias("n_labels"))
    per = per.join(n_lab, ent, "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))
    has = F.col("n_labels") > 0
    return per.select(
        *keys, "n_recs", "n_labels", "hits",
        (F.col("hits") / F.col("n_recs")).alias("precision"),
        F.when(has, F.col("hits") / F.col("n_labels")).alias("recall"),
        F.when(has, F.col("_ap") / F.col("n_labels")).otherwise(0.0).alias("ap"),
        F.when(has, F.col("_dcg") / _ideal_dcg(F.least(F.col("n_labels"), F.lit(k))))
         .otherwise(0.0).alias("ndcg"),
        F.when(has, (F.col("_pos") / F.col("n_recs") * 100.0
                     + (F.col("n_labels") - F.col("hits")) * 100.0) / F.col("n_labels"))
         .otherwise(0.0).alias("pr"))


def _summarise(per: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    g = list(group)
    agg = [F.avg("ap").alias("map"), F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"),
           F.avg("recall").alias("recall"), F.avg("pr").alias("mpr")]
    out = per.groupBy(*g).agg(*agg) if g else per.agg(*agg)
    p, r = F.col("precision"), F.col("recall")
    return out.select(*g, "map", "ndcg",
                      (F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"),
                      "precision", "recall", "mpr")


def ranking_metrics(recs: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """One row (map, ndcg, f1, precision, recall, mpr)."""
    return _summarise(per_entity(recs, labels, k))


def evaluate_at(recs: DataFrame, labels: DataFrame, ns: Sequence[int] = N_LIST, k: int = 10) -> DataFrame:
    """(n, map, ndcg, f1, precision, recall, mpr) for the first n of each list.

    The longest list is made, written and joined once. Of each list the ranks of its hits are
    kept (at most as many as it has rows), and every n takes those up to n. Lengths are
    counted where the lists lie, and only hits are gathered after the join.
    """
    lab = labels.select("entity", "item_id").distinct()
    n_lab = lab.groupBy("entity").agg(F.count(F.lit(1)).alias("n_labels"))
    recs = written(recs.select("entity", "rank", "item_id"), "recs")
    hits = (recs.join(lab, ["entity", "item_id"]).groupBy("entity")
                .agg(F.array_sort(F.collect_list(F.col("rank").cast("double"))).alias("_h")))
    lengths = recs.groupBy("entity").agg(*[F.count_if(F.col("rank") <= int(n)).alias(f"_{int(n)}") for n in ns])
    lists = lengths.join(hits, "entity", "left").withColumn("_r", F.coalesce("_h", F.array().cast("array<double>")))

    def cut(n: int) -> Column:
        return F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("n_recs"), F.filter("_r", lambda r: r <= n).alias("_r"))

    cuts = F.array(*[cut(int(n)) for n in sorted(ns)])
    rows = lists.join(n_lab, "entity", "left").select("entity", "n_labels", F.explode(cuts).alias("_x"))
    return _rank_scores(rows.select("entity", "n_labels", "_x.*").filter(F.col("n_recs") > 0), ["n"], k)


def evaluate_hits(lists: DataFrame, labels: DataFrame, group: Sequence[str], k: int = 10) -> DataFrame:
    """(group..., map, ndcg, f1, precision, recall, mpr) of many parameter sets (and folds)
    out of ``lists`` (group..., entity, n_recs, ranks): of each list its length and the
    ranks of its hits, ascending. Labels may carry some of the ``group`` columns."""
    ent = [c for c in [*group, "entity"] if c in labels.columns]
    n_lab = labels.select(*ent, "item_id").distinct().groupBy(*ent).agg(F.count(F.lit(1)).alias("n_labels"))
    rows = lists.withColumn("_r", F.transform("ranks", lambda r: r.cast("double"))).join(n_lab, ent, "left")
    return _rank_scores(rows, group, k)


def _rank_scores(rows: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """The metrics of each ``group`` out of its lists (group..., entity, n_recs, n_labels) with
    the ranks ``_r`` of their hits."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    return _set_scores(rows.select(
        *group, "entity", "n_labels", "n_recs", F.size("_r").alias("hits"),
        total(F.transform("_r", lambda r, i: (i + F.lit(1)) / r)).alias("_ap"),
        total(F.transform(F.filter("_r", lambda r: r <= k), lambda r: F.lit(1.0) / F.log(r + F.lit(1.0)))).alias("_dcg"),
        total(F.transform("_r", lambda r: r - F.lit(1.0))).alias("_pos")), group, k)


def evaluate_sets(recs: DataFrame, labels: DataFrame, group: Sequence[str], k: int = 10) -> DataFrame:
    """(group..., map, ndcg, f1, precision, recall, mpr): the written lists of many
    parameter sets (and folds) scored in one pass. Labels may carry some of the ``group``
    columns (the fold); they serve every set of the others.

    The lists are read twice: for their lengths, and for their hits, the only rows that
    are ranked and summed."""
    keys = [*group, "entity"]
    ent = [c for c in keys if c in labels.columns]
    lab = labels.select(*ent, "item_id").distinct()
    n_lab = lab.groupBy(*ent).agg(F.count(F.lit(1)).alias("n_labels"))
    per = _hit_sums(recs.join(lab, [*ent, "item_id"]), keys, k)
    lengths = recs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_recs"))
    return _set_scores(lengths.join(per, keys, "left").join(n_lab, ent, "left"), group, k)


def _set_scores(every: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """The metrics of each ``group`` out of its lists (group..., entity, n_recs) with their
    sums over hits (``_hit_sums``) and n_labels, null where there are none."""
    m, h = F.col("n_labels"), F.col("hits")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    has = F.coalesce(m, F.lit(0)) > 0
    hits = F.coalesce(h, F.lit(0))
    return _summarise(every.select(
        *group, "entity", (hits / F.col("n_recs")).alias("precision"), F.when(has, hits / m).alias("recall"),
        F.when(has, none("_ap") / m).otherwise(0.0).alias("ap"),
        F.when(has, none("_dcg") / _ideal_dcg(F.least(m, F.lit(k)))).otherwise(0.0).alias("ndcg"),
        F.when(has, (none("_pos") / F.col("n_recs") * 100.0 + (m - hits) * 100.0) / m).otherwise(0.0).alias("pr")), list(group))


def _hit_sums(hits: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys..., hits, _ap, _dcg, _pos) out of the hits (keys..., rank) of each list."""
    rank = F.col("rank").cast("double")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    return hits.withColumn("_c", nth).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("_c") / rank).alias("_ap"),
        F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / F.log(rank + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(rank - 1.0).alias("_pos"))


def evaluate_same_lists(ranked: DataFrame, entities: DataFrame, labels: DataFrame, group: Sequence[str],
                        k: int = 10) -> DataFrame:
    """(group..., map, ndcg, f1, precision, recall, mpr) of many parameter sets (and
    folds) where each has one list (group..., rank, item_id; a bounded number of rows)
    for all its ``entities``.

    ``entities`` (entity) and ``labels`` (entity, item_id) carry the columns of ``group``
    by which they differ (the fold). As in ``evaluate_same_list`` the labels meet the
    lists, and the table entity x list is never made.
    """
    shared = [c for c in group if c in labels.columns]
    ent = [*shared, "entity"]
    known = entities.select(*ent).distinct()
    lab = labels.select(*ent, "item_id")
    # the labels are dealt once, to be counted; those on a list are few
    n_lab = lab.distinct().groupBy(*ent).agg(F.count(F.lit(1)).alias("n_labels")).join(known, ent, "left_semi")
    listed = F.broadcast(ranked.select(*shared, "item_id").distinct())  # a list's length x sets rows
    hits = (lab.join(listed, [*shared, "item_id"], "left_semi").distinct().join(known, ent, "left_semi")
               .join(F.broadcast(ranked), [*shared, "item_id"]))
    sizes = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n_recs"))
    m, h = F.col("n_labels"), F.col("hits")
    # a hit takes its place's percentile off the 100 that a label without one has
    sums = _hit_sums(hits, [*group, "entity"], k).join(n_lab, ent).join(F.broadcast(sizes), list(group)).groupBy(*group).agg(
        F.sum(F.col("_ap") / m).alias("ap"), F.sum(F.col("_dcg") / _ideal_dcg(F.least(m, F.lit(k)))).alias("ndcg"),
        F.sum(h / F.col("n_recs")).alias("p"), F.sum(h / m).alias("r"),
        F.sum((h * 100.0 - F.col("_pos") / F.col("n_recs") * 100.0) / m).alias("off"))
    counted = [known.withColumn("e", F.lit(1)).withColumn("l", F.lit(0)), n_lab.select(*ent).withColumn("e", F.lit(0)).withColumn("l", F.lit(1))]
    both = counted[0].unionByName(counted[1]).groupBy(*shared).agg(F.sum("e").alias("e"), F.sum("l").alias("l"))
    rows = sizes.join(both, shared) if shared else sizes.crossJoin(both)  # one row a set
    mean = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("ap", "ndcg", "p", "r", "off")}
    e = F.col("e")
    out = (rows.filter(e > 0).join(sums, list(group), "left")
               .select(*group, (mean["ap"] / e).alias("map"), (mean["ndcg"] / e).alias("ndcg"), (mean["p"] / e).alias("precision"),
                       (mean["r"] / F.nullif(F.col("l"), F.lit(0))).alias("recall"), ((F.col("l") * 100.0 - mean["off"]) / e).alias("mpr")))
    p, r = F.col("precision"), F.col("recall")
    return out.select(*group, "map", "ndcg", (F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), "precision", "recall", "mpr")


def evaluate_same_list(ranked: DataFrame, entities: DataFrame, labels: DataFrame, ns: Sequence[int] = N_LIST,
                       k: int = 10) -> DataFrame:
    """(n, map, ndcg, f1, precision, recall, mpr) where every one of ``entities``
    (entity) has the same list ``ranked`` (rank, item_id; a bounded number of rows).

    Seen from the labels' side: labels meet the one list, and an entity adds to the
    sums what its hits give. Entities without a hit, or without labels, are counts,
    so the table entity x list is never made.
    """
    known = entities.select("entity").distinct()
    lab = labels.select("entity", "item_id")
    # the labels are dealt once, to be counted; those on the list are few
    n_lab = lab.distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_labels")).join(known, "entity", "left_semi")
    cuts = F.array(*[F.lit(int(n)) for n in sorted(ns)])
    listed = ranked.select("item_id", "rank")  # at most max(ns) rows
    hits = (lab.join(F.broadcast(listed.select("item_id").distinct()), "item_id", "left_semi").distinct()
               .join(known, "entity", "left_semi").join(F.broadcast(listed), "item_id")
               .select("entity", "rank", F.explode(F.filter(cuts, lambda n: n >= F.col("rank"))).alias("n")))
    rank = F.col("rank").cast("double")
    nth = F.row_number().over(Window.partitionBy("n", "entity").orderBy("rank"))
    per = (hits.withColumn("_c", nth).groupBy("n", "entity").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("_c") / rank).alias("_ap"),
        F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / F.log(rank + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(rank - 1.0).alias("_pos")).join(n_lab, "entity"))
    length = ranked.count()
    sizes = entities.sparkSession.createDataFrame([(int(n), min(int(n), length)) for n in sorted(ns)], "n INT, n_recs INT")
    m, h = F.col("n_labels"), F.col("hits")
    # a hit takes its place's percentile off the 100 that a label without one has
    sums = per.join(F.broadcast(sizes), "n").groupBy("n").agg(
        F.sum(F.col("_ap") / m).alias("ap"), F.sum(F.col("_dcg") / _ideal_dcg(F.least(m, F.lit(k)))).alias("ndcg"),
        F.sum(h / F.col("n_recs")).alias("p"), F.sum(h / m).alias("r"),
        F.sum((h * 100.0 - F.col("_pos") / F.col("n_recs") * 100.0) / m).alias("off"))
    n_entities, n_known = known.count(), n_lab.count()  # entities, and those with labels
    every, labelled = F.lit(float(max(1, n_entities))), F.lit(float(n_known))
    mean = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("ap", "ndcg", "p", "r", "off")}
    out = (sizes.join(sums, "n", "left").filter((F.col("n_recs") > 0) & F.lit(n_entities > 0))
                .select("n", (mean["ap"] / every).alias("map"), (mean["ndcg"] / every).alias("ndcg"), (mean["p"] / every).alias("precision"),
                        F.when(labelled > 0, mean["r"] / F.nullif(labelled, F.lit(0.0))).alias("recall"),
                        ((labelled * 100.0 - mean["off"]) / every).alias("mpr")))
    p, r = F.col("precision"), F.col("recall")
    return out.select("n", "map", "ndcg", (F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), "precision", "recall", "mpr")


def metric(recs: DataFrame, labels: DataFrame, name: str, k: int = 10) -> DataFrame:
    """One metric as a one-row table (column named after it)."""
    if name not in METRIC_COLUMNS:
        raise ValueError(f"metric must be one of {METRIC_COLUMNS}")
    return ranking_metrics(recs, labels, k).select(name)


def hit_counts(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, n_recs, n_labels, hits): intersection sizes, both directions equal
    here because items are unique per list."""
    return per_entity(recs, labels).select("entity", "n_recs", "n_labels", "hits")


def rank_percentile(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, item_id, pr): percentile rank of each label in its entity's list."""
    size = recs.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    return (labels.select("entity", "item_id").join(size, "entity")
                  .join(recs.select("entity", "item_id", "rank"), ["entity", "item_id"], "left")
                  .select("entity", "item_id",
                          F.when(F.col("rank").isNull(), F.lit(100.0))
                           .otherwise((F.col("rank") - 1.0) / F.col("_n") * 100.0).alias("pr")))


def recs_by_entity(recs: DataFrame) -> DataFrame:
    """(entity, n, items): each list gathered in rank order (items as an array)."""
    return recs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"])
         .alias("items"))


def labels_by_entity(labels: DataFrame) -> DataFrame:
    """(entity, n, items): each entity's label items, ascending."""
    return labels.groupBy("entity").agg(F.count(F.lit(1)).alias("n"),
                                        F.array_sort(F.collect_list("item_id")).alias("items"))


def prediction_labels(recs: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, recs, labels): lists paired by entity; missing labels are an empty array."""
    r = recs_by_entity(recs).select("entity", F.col("items").alias("recs"))
    lab = labels_by_entity(labels).select("entity", F.col("items").alias("labels"))
    return r.join(lab, "entity", "left").select(
        "entity", "recs", F.coalesce("labels", F.array().cast(r.schema["recs"].dataType)).alias("labels"))


def label_blocks(labels: DataFrame, item_index: DataFrame, size: int = 1024) -> DataFrame:
    """(entity, block, n, items): each entity's label items in arrays of at most ``size``.

    Items are dealt by their position in ``item_index`` (id, idx): block b holds those
    at positions b * size to b * size + size - 1, ascending, n is how many there are. So
    the longest array is bounded whatever the number of an entity's labels, an
    entity with very many is spread over tasks, and blocks in order of b join to its
    whole list."""
    at = item_index.select(F.col("id").alias("item_id"), F.col("idx").cast("long").alias("_idx"))
    rows = labels.select("entity", "item_id").distinct().join(at, "item_id")
    return (rows.groupBy("entity", F.expr(f"_idx div {size}").alias("block"))
                .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_idx", "item_id"))).alias("x"))
                .select("entity", "block", "n", F.transform("x", lambda v: v["item_id"]).alias("items")))

"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are scaled to unit length, where the largest cosine is the smallest
Euclidean distance, and projected on ``dims`` Gaussian (2-stable) directions: for
a pair at distance d, (projected distance / d)**2 follows a chi-square law with
``dims`` degrees of freedom. A kd-tree over the projections gives a query its
neighbours in order of projected distance; each is verified on the original
vectors, and the search stops when the chi-square test holds: a neighbour nearer
than the k-th found would, with probability ``confidence``, already have come.

The projected space is cut into cells by a kd-tree over a bounded sample; every
row is indexed in its cell. A cell is worked on in parts of about ``part_rows``
rows (by hash of the id, so that a vector that a third of all rows share is
spread). Round one searches a query's own cell; round two the other cells whose
box passes the same test with the distance found. A cell's queries are dealt to
blocks of about ``query_rows``, and a part is searched once per block of its cell, so
that both sides of a task are bounded whatever the table's size. No pair is made but
those verified inside a part.

Nulls: vectors that are null, zero or hold null or non-finite components, and rows
with a null id, take no part; vectors are compared with those of their own length.
Ties go to the smaller id. An id on several rows counts once, with its smallest
vector. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm.common import prepare, stored


@dataclass(frozen=True)
class AnnSpec:
    dims: int = 8  # even
    confidence: float = 0.96
    part_rows: int = 8192
    query_rows: int = 4096
    leaf_rows: int = 48
    sample_rows: int = 20_000
    seed: int = 5


def directions(length: int, spec: AnnSpec) -> np.ndarray:
    return np.random.default_rng([spec.seed, length]).standard_normal((length, spec.dims))


def chi_square(x: np.ndarray | float, dims: int) -> np.ndarray | float:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def _quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


class KdTree:
    """Leaves of a median-split tree over points, with their boxes."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        spans, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            part = points[self.order[a:b]]
            if b - a <= leaf_rows:
                spans.append((a, b))
                continue
            wide = part.max(axis=0) - part.min(axis=0)
            axis, mid = int(wide.argmax()), (b - a) // 2
            if wide[axis] == 0:  # equal points
                spans.append((a, b))
                continue
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        spans.sort()
        self.first = np.array([a for a, _ in spans])
        self.last = np.array([b for _, b in spans])
        p = points[self.order]
        self.low = np.minimum.reduceat(p, self.first, axis=0)
        self.high = np.maximum.reduceat(p, self.first, axis=0)
        self.points = p

    def boxes(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def _search(tree: KdTree, ids: np.ndarray, raw: np.ndarray, norms: np.ndarray, qid: int, q: np.ndarray,
            qproj: np.ndarray, k: int, bound: float, stop: float) -> list[tuple[float, int]]:
    """The k nearest rows of a part found before the test holds: (score, id), best first.
    ``bound`` is a cosine that k rows elsewhere reach."""
    qnorm = math.sqrt(float((q * q).sum()))
    box = tree.boxes(qproj)
    order = np.argsort(box, kind="stable")
    best: list[tuple[float, int]] = []
    wait, wait_d = np.zeros(0, np.int64), np.zeros(0)
    at, step = 0, 4
    while at < len(order) or len(wait):
        kth = max(bound, best[k - 1][0] if len(best) >= k else -2.0)
        reach = stop * max(0.0, 2 - 2 * kth)
        if at < len(order) and not len(wait) and box[order[at]] > reach:
            break
        leaves = order[at:at + step]
        at, step = at + step, step * 2
        if len(leaves):
            n = tree.last[leaves] - tree.first[leaves]
            rows = np.repeat(tree.first[leaves] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            gap = tree.points[rows] - qproj
            wait = np.concatenate([wait, rows])
            wait_d = np.concatenate([wait_d, np.einsum("ij,ij->i", gap, gap)])
        frontier = box[order[at]] if at < len(order) else np.inf
        ready = wait_d <= min(frontier, reach)
        if frontier >= reach:  # nothing beyond the reach will be needed
            wait, wait_d, rows = wait[:0], wait_d[:0], wait[ready]
            at = len(order)
        else:
            rows, wait, wait_d = wait[ready], wait[~ready], wait_d[~ready]
        if len(rows):
            rows = tree.order[rows]
            score = (raw[rows] * q).sum(axis=1) / (norms[rows] * qnorm)
            ok = (score >= kth) & (ids[rows] != qid)
            got = sorted(zip((-score[ok]).tolist(), ids[rows[ok]].tolist(), strict=True))[:k] if ok.sum() <= 64 else \
                _top(score[ok], ids[rows[ok]], k)
            best = sorted([*best, *((-s, i) for s, i in got)], key=lambda r: (-r[0], r[1]))[:k]
    return best


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    order = np.lexsort((ids, -score))[:k]
    return list(zip((-score[order]).tolist(), ids[order].tolist(), strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 5, spec: AnnSpec | None = None, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score) of the ``k`` nearest other rows of each query."""
    spec = spec or AnnSpec()
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    clean = (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
                    .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("query"))
                    .where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                           & F.exists("v", lambda x: x != 0))
                    .groupBy("id").agg(F.min(F.struct("v", "query")).alias("x")).select("id", "x.v", "x.query"))
    rows = stored(clean.withColumn("len", F.size(v)), "vectors")
    total = {r[0]: r[1] for r in rows.groupBy("len").agg(F.count(F.lit(1))).collect()}
    trees = {n: _cells(rows.where(F.col("len") == n), n, c, spec) for n, c in total.items()}
    shared = spark.sparkContext.broadcast(trees)  # boxes of at most sample_rows / 8 cells per vector length

    def place(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            lens = b.column("len").to_numpy()
            for n in np.unique(lens):
                at = np.flatnonzero(lens == n)
                x = _matrix(b.column("v").take(pa.array(at)))
                cell[at] = shared.value[n].locate(_unit(x) @ directions(n, spec))
            yield b.append_column("cell", pa.array(cell))

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, query boolean, len int, cell int"), "cells")
    sizes = placed.groupBy("len", "cell").agg(F.count(F.lit(1)).alias("c"))
    parts = sizes.select("len", "cell", F.ceil(F.col("c") / spec.part_rows).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    key = ["len", "cell", "part", "block"]
    base = stored(placed.join(parts, ["len", "cell"])
                        .select("len", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v"), "indexed")
    queries = placed.where("query").select("id", "v", "len", "cell")

    def probe(asked: DataFrame) -> DataFrame:
        # at most as many rows as there are cells, sample_rows / 8 per vector length
        blocks = F.broadcast(asked.groupBy("len", "cell").agg(F.ceil(F.count(F.lit(1)) / spec.query_rows).cast("int").alias("blocks")))
        dealt = (asked.join(blocks, ["len", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int"))
                      .join(parts, ["len", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        rows = base.join(blocks, ["len", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return _probe(rows.select(*key, "id", "v"), dealt, key, k, spec)

    near = stored(probe(queries.withColumn("bound", F.lit(-2.0))), "round1")
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k scores per part of one cell
    bounds = kth.select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, F.element_at("s", k)).otherwise(-2.0).alias("bound"))

    def others(batches):
        stop = _quantile(spec.confidence, spec.dims)
        for b in batches:
            out_row, out_cell = [], []
            lens, cell, bound = (b.column(c).to_numpy() for c in ("len", "cell", "bound"))
            for i in range(b.num_rows):
                n = int(lens[i])
                q = _unit(_matrix(b.column("v").slice(i, 1))) @ directions(n, spec)
                d = shared.value[n].box_distances(q[0])
                ask = np.flatnonzero(d <= stop * max(0.0, 2 - 2 * bound[i]))
                ask = ask[ask != cell[i]]
                out_row += [i] * len(ask)
                out_cell += ask.tolist()
            t = b.select(["id", "v", "len", "bound"]).take(pa.array(out_row, pa.int64()))
            yield t.append_column("cell", pa.array(out_cell, pa.int32()))

    asked = (queries.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
                    .mapInArrow(others, "id long, v array<double>, len int, bound double, cell int"))
    far = probe(stored(asked, "asked"))  # read twice
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (near.unionByName(far).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """A binary tree of cuts over the projected space and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        dims = points.shape[1]
        inf = np.full(dims, np.inf)

        def node() -> int:
            for a in (self.axis, self.cut, self.left, self.right, self.leaf):
                a.append(-1)
            return len(self.axis) - 1

        todo = [(node(), points, leaves, -inf, inf)]
        while todo:
            at, p, n, low, high = todo.pop()
            wide = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(dims)
            a = int(wide.argmax())
            c = float(np.median(p[:, a])) if len(p) else 0.0
            if n <= 1 or wide[a] == 0 or not (p[:, a] < c).any():
                self.leaf[at] = len(boxes)
                boxes.append((low, high))
                continue
            self.axis[at], self.cut[at] = a, c
            self.left[at], self.right[at] = node(), node()
            lower, upper = high.copy(), low.copy()
            lower[a] = upper[a] = c
            todo.append((self.left[at], p[p[:, a] < c], n // 2, low, lower))
            todo.append((self.right[at], p[p[:, a] >= c], n - n // 2, upper, high))
        self.axis, self.cut, self.left, self.right, self.leaf = map(np.array, (self.axis, self.cut, self.left, self.right, self.leaf))
        self.low = np.array([b[0] for b in boxes])
        self.high = np.array([b[1] for b in boxes])

    def locate(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at].astype(np.int32)
            n = at[inner]
            at[inner] = np.where(p[inner, self.axis[n]] < self.cut[n], self.left[n], self.right[n])

    def box_distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def _cells(rows: DataFrame, length: int, count: int, spec: AnnSpec) -> Cells:
    """Cells of about ``part_rows`` rows, from a sample of at most ``sample_rows``."""
    some = rows.orderBy(F.xxhash64("id", F.lit(spec.seed))).limit(spec.sample_rows).select("v").collect()
    x = np.array([r[0] for r in some], float).reshape(len(some), length)
    leaves = max(1, min(-(-count // spec.part_rows), max(1, len(some) // 8)))
    return Cells(_unit(x) @ directions(length, spec), leaves)


def _probe(base: DataFrame, asked: DataFrame, key: list[str], k: int, spec: AnnSpec) -> DataFrame:
    """Each part's rows and a block of the queries sent to it meet in one task."""
    stop = _quantile(spec.confidence, spec.dims)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            ids = rows.column("id").to_numpy()
            raw = _matrix(rows.column("v").combine_chunks())
            order = np.argsort(ids)
            ids, raw = ids[order], np.ascontiguousarray(raw[order])
            turn = directions(raw.shape[1], spec)
            tree = KdTree(_unit(raw) @ turn, spec.leaf_rows)
            norms = np.sqrt((raw * raw).sum(axis=1))
            q = np.ascontiguousarray(_matrix(queries.column("v").combine_chunks()))
            proj = _unit(q) @ turn
            bounds = queries.column("bound").to_numpy()
            for i, qid in enumerate(queries.column("id").to_pylist()):
                for score, x in _search(tree, ids, raw, norms, qid, q[i], proj[i], k, float(bounds[i]), stop):
                    out[0].append(qid)
                    out[1].append(x)
                    out[2].append(score)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return (base.groupBy(*key).cogroup(asked.select(*key, "id", "v", "bound").groupBy(*key))
                .applyInArrow(run, "query_id long, id long, score double"))

"""Tiled sparse matrix product with an optional top-k per output row.

    out[r, q] = sum over t of x[r, t] * y[q, t]

X is (r, t, x) and Y is (q, t, y), both long tables keyed by the contraction
index t. Item-item cosine is X = Y = the column-normalised play matrix with
t = user; kNN scoring is X = plays (r = user, t = item), Y = neighbour lists
(q = item, t = neighbour) scaled by the neighbour-weight sum.

Why not a self-join on t: it emits every pair of entries that share a key, so a
user with a third of all rows would emit (N/3)^2 rows from one join key. Here the
output is cut into tiles of rows I x columns J, both at most a square's side long
once there are more columns than that, and the keys t into chunks c. One
``applyInPandas`` task per tile (I, J, c) multiplies its entries with numpy into a
dense accumulator, one row sub-block at a time so it never holds more than
``max_cells`` values, and all products inside a tile are summed before anything
leaves the task. An X entry is copied only to the column blocks that use its key, a
Y entry to the row blocks that do: with square tiles that is at most the number of
rows or columns over the side, and a tile holds at most a side of entries of any
key. Keys of more than ``heavy_key`` entries, which nearly every block uses, are
copied to all blocks as they are read; only the other keys are joined, so no join
key has more rows than that.

Large sparse inputs take blocks of rows instead of tiles (``row_block_product``): a
block gets its own X entries and, once for each key it uses, that key's Y entries as
packed lists, so an entry is copied at most to the blocks that use its key, every sum
is complete in its task and no partial cell is shuffled. A task multiplies some rows at
a time and yields their cells or lists before it takes the next. The number of blocks
is the smallest by which a block's Y entries stay under ``row_entries``, out of counts
per key; tiles remain for inputs where no number of blocks does that. Where the copies
would be more than ``copies`` times Y, nothing is copied: the lists are written once to
the shared folder (``write_lists``), and a block reads those of its keys there, so that
what is shuffled and written follows X and Y.

If every tile holds complete sums (one chunk: the whole input fits
``chunk_entries``), the tile keeps only its top-k per row, and where there are more
column blocks these lists are ranked once more; otherwise it emits its partial
cells, which are summed by (r, q) with a map-side combine, and the top-k is taken by
a ranked window that Spark runs as a WindowGroupLimit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions import shared_files as files
from playlens.session import scratch_path

OUT_SCHEMA = "r long, q long, v double"
TIE_DIGITS = 9          # values are ranked on this rounding so ties fall alike
_BATCH_PRODUCTS = 4_000_000
_SUBBLOCKS = 8          # passes of the accumulator per tile
_BROADCAST_KEYS = 1_000_000  # frequent keys are sent to all tasks up to so many


def _empty(ranked: bool = False) -> pd.DataFrame:
    cols = {"r": pd.Series([], dtype="int64"), "q": pd.Series([], dtype="int64"),
            "v": pd.Series([], dtype="float64")}
    if ranked:
        cols["rank"] = pd.Series([], dtype="int32")
    return pd.DataFrame(cols)


def _rank_key(v: np.ndarray) -> np.ndarray:
    """``rank_key`` on arrays: the same double arithmetic."""
    return np.rint(v * 10.0 ** TIE_DIGITS)


def _block(xt, xv, r_codes, r_uni, yt, yv, q_codes, q_uni, k, exclude, whole) -> pd.DataFrame:
    """Products of one row sub-block (X entries sorted by key) into a dense accumulator;
    ``whole`` says that its sums are complete."""
    n_r, n_q = len(r_uni), len(q_uni)
    acc = np.zeros(n_r * n_q, dtype=np.float64)
    y_start = np.searchsorted(yt, xt, side="left")
    y_count = np.searchsorted(yt, xt, side="right") - y_start
    cum = np.cumsum(y_count)
    lo = 0
    while lo < len(xt):
        base = cum[lo - 1] if lo > 0 else 0
        hi = max(int(np.searchsorted(cum, base + _BATCH_PRODUCTS, side="right")), lo + 1)
        cnt = y_count[lo:hi]
        total = int(cnt.sum())
        if total:
            rep = np.repeat(np.arange(lo, hi), cnt)
            first = np.repeat(np.cumsum(cnt) - cnt, cnt)
            yi = np.repeat(y_start[lo:hi], cnt) + (np.arange(total) - first)
            flat = r_codes[rep].astype(np.int64) * n_q + q_codes[yi]
            acc += np.bincount(flat, weights=xv[rep] * yv[yi], minlength=n_r * n_q)
        lo = hi
    acc = acc.reshape(n_r, n_q)

    if exclude == "self":
        pos = np.searchsorted(q_uni, r_uni)
        ok = (pos < n_q) & (q_uni[np.minimum(pos, n_q - 1)] == r_uni)
        acc[np.nonzero(ok)[0], pos[ok]] = 0.0
    elif exclude == "x_support":
        pos = np.searchsorted(q_uni, xt)
        ok = (pos < n_q) & (q_uni[np.minimum(pos, n_q - 1)] == xt)
        acc[r_codes[ok], pos[ok]] = 0.0

    if k is None:
        rr, qq = np.nonzero(_rank_key(acc) if whole else acc)
        return pd.DataFrame({"r": r_uni[rr], "q": q_uni[qq], "v": acc[rr, qq]})

    out_r, out_q, out_v = [], [], []
    for row in range(n_r):
        vals = acc[row]
        keys = _rank_key(vals)
        idx = np.flatnonzero(keys > 0)
        if idx.size == 0:
            continue
        keyv = keys[idx]
        if idx.size > k:
            thr = np.partition(keyv, idx.size - k)[idx.size - k]
            sel = keyv >= thr
            idx, keyv = idx[sel], keyv[sel]
        order = np.lexsort((q_uni[idx], -keyv))[:k]
        pick = idx[order]
        out_r.append(np.full(pick.size, r_uni[row], dtype=np.int64))
        out_q.append(q_uni[pick])
        out_v.append(vals[pick])
    if not out_r:
        return _empty(ranked=True)
    ranks = np.concatenate([np.arange(1, len(q) + 1, dtype=np.int32) for q in out_q])
    return pd.DataFrame({"r": np.concatenate(out_r), "q": np.concatenate(out_q), "v": np.concatenate(out_v),
                         "rank": ranks})


def _tile_products(pdf: pd.DataFrame, k: int | None, exclude: str | None,
                   max_cells: int = 1 << 24, whole: bool = True) -> pd.DataFrame:
    """All products of one tile, row sub-block by row sub-block so the dense
    accumulator never exceeds ``max_cells`` entries."""
    xs = pdf[pdf["side"] == 0]
    ys = pdf[pdf["side"] == 1]
    if xs.empty or ys.empty:
        return _empty(ranked=k is not None)
    xs = xs.sort_values("t", kind="stable")
    ys = ys.sort_values("t", kind="stable")
    xt = xs["t"].to_numpy(np.int64)
    yt = ys["t"].to_numpy(np.int64)
    xv = xs["v"].to_numpy(np.float64)
    yv = ys["v"].to_numpy(np.float64)
    r_codes, r_uni = pd.factorize(xs["a"].to_numpy(np.int64), sort=True)
    q_codes, q_uni = pd.factorize(ys["a"].to_numpy(np.int64), sort=True)
    rows_per = max(1, max_cells // max(1, len(q_uni)))
    parts = []
    for lo in range(0, len(r_uni), rows_per):
        hi = min(len(r_uni), lo + rows_per)
        m = (r_codes >= lo) & (r_codes < hi)
        parts.append(_block(xt[m], xv[m], r_codes[m] - lo, r_uni[lo:hi], yt, yv, q_codes, q_uni, k, exclude, whole))
    parts = [p for p in parts if len(p)]
    return pd.concat(parts, ignore_index=True) if parts else _empty(ranked=k is not None)


def tile_counts(nr: int, nq: int, entries: int, max_cells: int, chunk_entries: int, cores: int) -> tuple[int, int, int]:
    """(row blocks, column blocks, key chunks). A tile has at most _SUBBLOCKS passes of the
    bounded accumulator. All columns are one block while they are no more than the
    side of a square tile; beyond that tiles are square, which copies least."""
    cells = max_cells * _SUBBLOCKS
    side = max(1, math.isqrt(cells))
    n_cols = math.ceil(nq / side)
    n_rows = math.ceil(nr / max(1, cells // min(nq, side)))
    n_chunks = max(1, math.ceil(entries / chunk_entries))
    if n_chunks == 1 and n_rows * n_cols < cores:
        n_rows = cores  # a single key chunk: the blocks are the only source of parallelism
    return max(1, min(n_rows, nr)), n_cols, n_chunks


def tile_entries(xs: DataFrame, ys: DataFrame, n_rows: int, n_cols: int, n_chunks: int, heavy_key: int, entries: int,
                 own_block: bool = False) -> DataFrame:
    """(I, J, c, side, a, t, v): the entries of X (side 0) and Y (side 1) of each tile.

    With ``own_block`` an X entry (r, t) also goes to the column block where q = t lies.
    """
    row_block = F.pmod(F.xxhash64("a"), F.lit(n_rows)).cast("long")
    col_block = F.pmod(F.xxhash64("a"), F.lit(n_cols)).cast("long")
    chunk = F.pmod(F.xxhash64("t"), F.lit(n_chunks)).cast("long")
    xb, yb = xs.withColumn("I", row_block), ys.withColumn("J", col_block)
    x_users, y_users = yb.select("J", "t"), xb.select("I", "t")
    if own_block and n_cols > 1:
        x_users = x_users.unionByName(xs.select(F.pmod(F.xxhash64("t"), F.lit(n_cols)).cast("long").alias("J"), "t"))
    heavy = (xs.select("t").unionByName(ys.select("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > heavy_key).select("t", F.lit(True).alias("heavy")))
    if entries // max(1, heavy_key) <= _BROADCAST_KEYS:  # no more keys can be that frequent
        heavy = F.broadcast(heavy)

    def spread(rows: DataFrame, users: DataFrame, block: str, blocks: int) -> DataFrame:
        if blocks == 1:
            return rows.withColumn(block, F.lit(0).cast("long"))
        if entries <= heavy_key:  # no key is heavy
            return rows.join(users.distinct(), "t")
        marked = rows.join(heavy, "t", "left")
        every = marked.where("heavy").withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        some = marked.where("heavy is null").join(users.join(heavy, "t", "left_anti").distinct(), "t")
        return every.drop("heavy").unionByName(some.drop("heavy"))

    xt, yt = spread(xb, x_users, "J", n_cols), spread(yb, y_users, "I", n_rows)
    cols = ["I", "J", chunk.alias("c")]
    return (xt.select(*cols, F.lit(0).alias("side"), "a", "t", "v")
              .unionByName(yt.select(*cols, F.lit(1).alias("side"), "a", "t", "v")))


#: Y entries of one key in one packed list; a key of more has several lists.
LIST_ENTRIES = 4096
#: Lists of one key that are joined to the blocks using it; those of a larger key go to every block.
JOINED_LISTS = 16
#: Numbers of row blocks that are weighed, in units of the cores.
_BLOCK_STEPS = tuple(round(2 * 1.25 ** i, 4) for i in range(45))


def row_blocks(xs: DataFrame, ys: DataFrame, nr: int, row_entries: int, cores: int) -> tuple[int, float] | None:
    """The number of row blocks by which a block has at most ``row_entries`` Y entries
    (expected over the keys: a key of n X entries is used by a block with probability
    1 - (1 - 1 / blocks)^n), and the Y entries of all blocks together; None where no number
    up to the rows' does, or where one row has more X entries than that."""
    longest = xs.groupBy("a").count().agg(F.max("count")).first()[0] or 0
    if longest > row_entries:
        return None
    steps = sorted({min(nr, math.ceil(cores * s)) for s in _BLOCK_STEPS})
    counts = [d.filter(F.col("t").isNotNull()).groupBy("t").agg(F.count(F.lit(1)).cast("double").alias(n)) for d, n in ((xs, "nx"), (ys, "ny"))]
    keys = counts[0].join(counts[1], "t", "full").na.fill(0.0, ["nx", "ny"])
    loads = keys.agg(F.sum("nx").alias("nx"), *[F.sum(F.col("ny") * (1 - F.pow(F.lit(1 - 1 / b), F.col("nx")))).alias(f"b{b}") for b in steps]).first()
    fit = [b for b in steps if (loads[f"b{b}"] or 0) <= row_entries and (loads["nx"] or 0) / b <= row_entries]
    return (fit[0], fit[0] * (loads[f"b{fit[0]}"] or 0)) if fit else None


def _pieces(ys: DataFrame, list_entries: int) -> DataFrame:
    """``ys`` with ``k``, the number of lists its key has, and ``piece``, the entry's list among these."""
    large = (ys.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > list_entries)
               .select("t", F.ceil(F.col("n") / list_entries).cast("int").alias("k")))
    # broadcast, so that no entry is shuffled for it: at most the entries / list_entries keys
    return (ys.join(F.broadcast(large), "t", "left").withColumn("k", F.coalesce("k", F.lit(1)))
              .withColumn("piece", F.pmod(F.xxhash64("a"), F.col("k"))))


def row_block_entries(xs: DataFrame, ys: DataFrame, blocks: int, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """(I, t, a, v, qs, ys): of each block its X entries (a, v) and the packed Y entries
    (qs, ys) of the keys it uses."""
    block = F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("I")
    xs = xs.filter(F.col("a").isNotNull() & F.col("t").isNotNull())
    ys = ys.filter(F.col("a").isNotNull() & F.col("t").isNotNull())
    lists = (_pieces(ys, list_entries).groupBy("t", "k", "piece")
               .agg(F.array_sort(F.collect_list(F.struct("a", "v"))).alias("e"))
               .select("t", "k", F.col("e.a").alias("qs"), F.col("e.v").alias("ys")))
    users = xs.select("t", block).distinct()
    some = lists.filter(F.col("k") <= JOINED_LISTS).join(users, "t")
    every = lists.filter(F.col("k") > JOINED_LISTS).withColumn("I", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cols = ["I", "t", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("double").alias("v"), "qs", "ys"]
    own = xs.select(block, "t", "a", "v", F.lit(None).cast(lists.schema["qs"].dataType).alias("qs"),
                    F.lit(None).cast("array<double>").alias("ys"))
    return own.unionByName(some.select(*cols)).unionByName(every.select(*cols))


def _row_cells(keys: np.ndarray, vals: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (ascending; below ``cells``) and the sums of their values."""
    if cells <= 2 * len(keys):
        sums = np.bincount(keys, weights=vals, minlength=cells)
        found = np.flatnonzero(sums)
        return found, sums[found]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(vals[order], first) if len(keys) else vals


def _row_block(batches: Iterator[pa.RecordBatch], k: int | None, exclude: str | None,
               batch_products: int = _BATCH_PRODUCTS // 4) -> Iterator[pa.RecordBatch]:
    """The cells, or the k best of each row, of one row block: some rows at a time."""
    xr, xt, xv, lt, ln, yq, yv = [], [], [], [], [], [], []
    for b in batches:
        col = {n: b.column(n) for n in ("t", "a", "v", "qs", "ys")}
        t, packed = col["t"].to_numpy(zero_copy_only=False), col["qs"].is_valid().to_numpy(zero_copy_only=False)
        if not packed.all():
            own = pa.array(~packed)
            xt.append(t[~packed])
            xr.append(col["a"].filter(own).to_numpy(zero_copy_only=False))
            xv.append(col["v"].filter(own).to_numpy(zero_copy_only=False))
        if packed.any():
            lists = col["qs"].filter(pa.array(packed))
            lt.append(t[packed])
            ln.append(np.diff(lists.offsets.to_numpy()))
            yq.append(lists.flatten().to_numpy())
            yv.append(col["ys"].filter(pa.array(packed)).flatten().to_numpy())
    if not xr or not yq:
        return
    xr, xt, xv, lt, ln, yq, yv = (np.concatenate(a) for a in (xr, xt, xv, lt, ln, yq, yv))
    starts = np.cumsum(ln) - ln
    order = np.argsort(lt, kind="stable")  # lists by key; their entries stay in place
    lt, ln, starts = lt[order], ln[order], starts[order]
    reach = np.r_[0, np.cumsum(ln)]
    order = np.lexsort((xt, xr))
    xr, xt, xv = xr[order], xt[order], xv[order]
    lo, hi = np.searchsorted(lt, xt, side="left"), np.searchsorted(lt, xt, side="right")
    cum = np.r_[0, np.cumsum(reach[hi] - reach[lo])]  # products up to each X entry
    row_at = np.flatnonzero(np.r_[True, xr[1:] != xr[:-1]])
    row_end = np.r_[row_at[1:], len(xr)]
    least = int(yq.min())
    names = None
    span = int(yq.max()) - least + 1
    if span > 1 << 40:  # ids far apart: places among the block's ids
        names = np.unique(yq)
        span = len(names)

    def place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if names is None:
            return ids.astype(np.int64) - least, (ids >= least) & (ids < least + span)
        at = np.minimum(np.searchsorted(names, ids), span - 1)
        return at, names[at] == ids

    def products(e0: int, e1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(X entry, Y entry's place, product) of the X entries e0 to e1."""
        n_lists = hi[e0:e1] - lo[e0:e1]
        entry = np.repeat(np.arange(e0, e1), n_lists)
        which = np.repeat(lo[e0:e1], n_lists) + np.arange(len(entry)) - np.repeat(np.cumsum(n_lists) - n_lists, n_lists)
        n = ln[which]
        y = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        entry = np.repeat(entry, n)
        return entry, place(yq[y])[0], xv[entry] * yv[y]

    def rows_cells(r0: int, r1: int) -> tuple[np.ndarray, np.ndarray]:
        e0, e1 = row_at[r0], row_end[r1 - 1]
        row_of = np.repeat(np.arange(r1 - r0), row_end[r0:r1] - row_at[r0:r1])
        if r1 - r0 > 1 or cum[e1] - cum[e0] <= batch_products:
            entry, q, v = products(e0, e1)
            return _row_cells(row_of[entry - e0] * span + q, v, (r1 - r0) * span)
        keys, sums = np.zeros(0, np.int64), np.zeros(0)  # a row of very many products: in steps
        while e0 < e1:
            to = min(e1, max(e0 + 1, int(np.searchsorted(cum, cum[e0] + batch_products, side="right")) - 1))
            _, q, v = products(e0, to)
            keys, sums = _row_cells(np.r_[keys, q], np.r_[sums, v], span)
            e0 = to
        return keys, sums

    r0 = 0
    while r0 < len(row_at):
        base = cum[row_at[r0]]
        r1 = max(r0 + 1, int(np.searchsorted(cum[row_end], base + batch_products, side="right")))
        keys, v = rows_cells(r0, r1)
        if exclude is not None:
            e0, e1 = row_at[r0], row_end[r1 - 1]
            row_of = np.repeat(np.arange(r1 - r0), row_end[r0:r1] - row_at[r0:r1])
            at, ok = place(xt[e0:e1]) if exclude == "x_support" else place(xr[e0:e1])
            out = (row_of * span + at)[ok]
            kept = ~np.isin(keys, out)
            keys, v = keys[kept], v[kept]
        rank = _rank_key(v)
        kept = rank != 0 if k is None else rank > 0
        keys, v, rank = keys[kept], v[kept], rank[kept]
        row, q = keys // span, keys % span
        q = q + least if names is None else names[q]
        if k is None:
            for i in range(0, len(q), 1 << 20):
                part = slice(i, i + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(xr[row_at[r0 + row[part]]].astype(np.int64)), pa.array(q[part].astype(np.int64)),
                                                  pa.array(v[part])], names=["r", "q", "v"])
        elif len(q):
            cut = np.searchsorted(row, np.arange(r1 - r0 + 1))
            picks, ranks = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                at = np.arange(a, b)
                if b - a > k:
                    at = at[rank[a:b] >= np.partition(rank[a:b], b - a - k)[b - a - k]]
                at = at[np.argsort(-rank[at], kind="stable")][:k]  # q ascends within a row
                picks.append(at)
                ranks.append(np.arange(1, len(at) + 1, dtype=np.int32))
            at = np.concatenate(picks)
            yield pa.RecordBatch.from_arrays([pa.array(xr[row_at[r0 + row[at]]].astype(np.int64)), pa.array(q[at].astype(np.int64)),
                                              pa.array(v[at]), pa.array(np.concatenate(ranks))], names=["r", "q", "v", "rank"])
        r0 = r1


#: Y entries of one file of lists.
FILE_ENTRIES = 1 << 20


def write_lists(ys: DataFrame, n: int, list_entries: int = LIST_ENTRIES, file_entries: int = FILE_ENTRIES) -> tuple[str, int]:
    """(folder, files): the ``n`` Y entries (a, t, v) once, as files of packed lists in the
    order of their keys. Keys are dealt to files, a key of many entries list by list."""
    folder = scratch_path(ys.sparkSession, "lists")
    shards = max(1, math.ceil(n / file_entries))
    dealt = (_pieces(ys.filter(F.col("a").isNotNull() & F.col("t").isNotNull()), list_entries)
             .select(F.pmod(F.xxhash64("t", "piece"), F.lit(shards)).cast("int").alias("shard"), "t", "a", "v"))

    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, a, v = (np.concatenate(c) for c in zip(*[[b.column(n).to_numpy(zero_copy_only=False) for n in ("t", "a", "v")] for b in batches],
                                                  strict=True))
        order = np.lexsort((v, a, t))
        t = t[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        s = key[0].as_py()
        for name, x in (("keys", t[first]), ("ends", np.r_[first[1:], len(t)]), ("qs", a[order]), ("ys", v[order])):
            files.save(folder, f"{name}-{s}", x)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    done = dealt.groupBy("shard").applyInArrow(write, "shard int").count()
    if done < shards:  # few keys: some files have none
        held = {r["shard"] for r in dealt.select("shard").distinct().collect()}
        empty = {"keys": np.int64, "ends": np.int64, "qs": np.int64, "ys": np.float64}
        for s in set(range(shards)) - held:
            for name, kind in empty.items():
                files.save(folder, f"{name}-{s}", np.zeros(0, kind))
    return folder, shards


def read_lists(folder: str, shards: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The stored lists of the sorted distinct ``keys``, as ``row_block_entries`` has them."""
    for s in range(shards):
        held = np.asarray(files.load(folder, f"keys-{s}"))
        at = np.searchsorted(held, keys)
        at = at[(at < len(held)) & (held[np.minimum(at, max(len(held) - 1, 0))] == keys)] if len(held) else at[:0]
        if not len(at):
            continue
        ends = np.asarray(files.load(folder, f"ends-{s}"))
        begin, n = np.r_[0, ends[:-1]][at], ends[at] - np.r_[0, ends[:-1]][at]
        off = np.r_[0, np.cumsum(n)]
        take = np.repeat(begin - off[:-1], n) + np.arange(off[-1])
        cols = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(files.load(folder, f"{c}-{s}")[take])) for c in ("qs", "ys")]
        yield pa.RecordBatch.from_arrays([pa.array(held[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64()), *cols],
                                         names=["t", "a", "v", "qs", "ys"])


def row_block_product(xs: DataFrame, ys: DataFrame, blocks: int, k: int | None, exclude: str | None,
                      stored: tuple[str, int] | None = None) -> DataFrame:
    """(r, q, v), with k also rank: the product by ``blocks`` blocks of rows, Y copied to
    the blocks, or read by them where its lists are ``stored``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _row_block(batches, k, exclude)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.append_column("qs", pa.nulls(b.num_rows, pa.list_(pa.int64()))).append_column("ys", pa.nulls(b.num_rows, pa.list_(pa.float64())))
               for b in batches]
        used = np.unique(np.concatenate([b.column("t").to_numpy(zero_copy_only=False) for b in own]))
        return _row_block(chain(own, read_lists(*stored, used)), k, exclude)

    schema = OUT_SCHEMA if k is None else OUT_SCHEMA + ", rank int"
    if stored is None:
        return row_block_entries(xs, ys, blocks).groupBy("I").applyInArrow(run, schema)
    dealt = xs.filter(F.col("a").isNotNull() & F.col("t").isNotNull()).select(
        F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("I"), "t", "a", "v")
    return dealt.groupBy("I").applyInArrow(read, schema)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path``, by columns and compressed, and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sparse_product(x: DataFrame, y: DataFrame | None = None, k: int | None = None, exclude: str | None = None,
                   max_cells: int = 1 << 24, chunk_entries: int = 4_000_000,
                   heavy_key: int = 1_000_000, row_entries: int = 12_000_000, copies: float = 2.0) -> DataFrame:
    """(r, q, v): the product, or its top-k per r (by v desc, q asc) with v > 0.

    Values count as equal, zero or positive by ``rank_key``, whichever way the sums
    were put together, so the result doesn't depend on the tiling.

    x: (r, t, x), y: (q, t, y), by default x with its rows as q. ``exclude``: 'self' drops
    q == r, 'x_support' drops cells (r, q) where X has an entry (r, t = q). The sizes used
    for tiling are scalars. ``row_entries`` bounds the Y entries of a block of rows,
    ``copies`` how many times its size Y is copied to them.
    """
    # Each input written once in the shared folder: the sizing below and the tiling read
    # it instead of recomputing the upstream plan, and a lost executor does not replay that plan.
    spark, cores = x.sparkSession, x.sparkSession.sparkContext.defaultParallelism
    y_path = scratch_path(spark, "product-y")
    xs = _stored(x.select(F.col("r").cast("long").alias("a"), F.col("t").cast("long").alias("t"),
                          F.col("x").cast("double").alias("v")).filter(F.col("v") != 0), scratch_path(spark, "product-x"))
    ys = xs if y is None else _stored(y.select(F.col("q").cast("long").alias("a"), F.col("t").cast("long").alias("t"),
                                               F.col("y").cast("double").alias("v")).filter(F.col("v") != 0), y_path)
    sizes = [F.count(F.lit(1)), F.approx_count_distinct("a"), F.min("a"), F.max("a")]
    nx, nr, *ids = xs.agg(*sizes).first()
    ny, nq, *q_ids = (nx, nr, *ids) if y is None else ys.agg(*sizes).first()
    nr, nq = max(1, int(nr)), max(1, int(nq))
    n_rows, n_cols, n_chunks = tile_counts(nr, nq, nx + ny, max_cells, chunk_entries, cores)
    if n_chunks > 1 or n_cols > 1:
        blocks = row_blocks(xs, ys, nr, row_entries, cores)
        if blocks:
            if q_ids[0] is not None and q_ids[0] >= -(1 << 31) and q_ids[1] < 1 << 31:  # half the bytes of a packed id
                ys = ys.withColumn("a", F.col("a").cast("int"))
            if blocks[1] <= copies * ny:
                return row_block_product(xs, ys, blocks[0], k, exclude)
            lists = write_lists(ys, ny)
            if y is not None:
                files.drop(y_path)  # what the blocks read are the lists
            return row_block_product(xs, ys, blocks[0], k, exclude, lists)
    fast = n_chunks == 1
    tiles = tile_entries(xs, ys, n_rows, n_cols, n_chunks, heavy_key, nx + ny, own_block=exclude == "x_support")
    keep_k = k if fast else None
    excl = exclude if fast else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_products(pdf, keep_k, excl, max_cells, fast)

    if fast and k is not None:
        # A tile holds its rows' complete sums: its top-k (ranked in the task) is final
        # with one column block, and all that is needed of it with several.
        top = tiles.groupBy("I", "J", "c").applyInPandas(run, OUT_SCHEMA + ", rank int")
        return top if n_cols == 1 else top_k_per_row(top.drop("rank"), k)
    cells = tiles.groupBy("I", "J", "c").applyInPandas(run, OUT_SCHEMA)
    if k is None and fast:
        return cells
    cells = cells.groupBy("r", "q").agg(F.sum("v").alias("v"))
    if exclude == "self":
        cells = cells.filter(F.col("r") != F.col("q"))
    elif exclude == "x_support":
        support = xs.select(F.col("a").alias("r"), F.col("t").alias("q"))
        cells = cells.join(support, ["r", "q"], "left_anti")
    if k is None:
        return cells.filter(rank_key(F.col("v")) != 0)
    return top_k_per_row(cells.filter(rank_key(F.col("v")) > 0), k)


def rank_key(v: Column) -> Column:
    """What ranks are made by at every size: the value in units of 10**-TIE_DIGITS,
    rounded as a double (no integer that large values would overflow), by the same
    arithmetic as in the tiles."""
    return F.rint(v * F.lit(10.0 ** TIE_DIGITS))


def top_k_per_row(cells: DataFrame, k: int) -> DataFrame:
    """(r, q, v, rank): the k largest v per r, ties by q ascending."""
    w = Window.partitionBy("r").orderBy(rank_key(F.col("v")).desc(), F.col("q"))
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

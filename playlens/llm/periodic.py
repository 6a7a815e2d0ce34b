"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q and length >= max(min_length,
times * q) that no neighbouring word extends keeping period q.

Each text's suffixes are ordered by words (prefix doubling, of the suffixes whose
first words repeat), with the longest common prefix (LCP) of neighbours in that
order. The neighbours are edges, taken by falling LCP as by Kruskal: an edge unites
the classes of its two suffixes, so that at level l a class holds the places where
the same l words begin. A class is kept as its places in order (the smaller one is
merged into the larger one by union-find). Where two places i < j become neighbours
in a class at level l, with j - i <= l, the words from i to j + l have period j - i
and no word after them keeps it: a seed. It is a run if the word before i does not
keep the period either and it is long enough.

Why every run is found, once, with its smallest period: let a run begin at s, with
smallest period q and length L >= 2 q. The places s and s + q share exactly L - q
words, so they become members of one class at level L - q, and no place between them
is in that class, as it would give the run a smaller period. Levels below those that
a run can have are not looked at.

A text is one row and is worked on as a whole, in memory that grows with its words;
texts share nothing, so there is no shuffle and a lost task is only run again.

Nulls: a null or empty text, or one without a word, has no run and nothing collapsed.
A null id is passed through; its row is worked on like any other. Repeated rows are
worked on each, an empty table gives no row. Extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import prepare, tidy


@dataclass(frozen=True)
class RunSpec:
    times: int = 4
    min_length: int = 6

    def __post_init__(self):
        if self.times < 2 or self.min_length < 1:
            raise ValueError("a run repeats its period twice at least")

    @property
    def level(self) -> int:
        """The smallest LCP that a run's first two periods can have."""
        return min(max(self.times * q, self.min_length) - q for q in range(1, self.min_length + 1))


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (high, low)."""
    return np.unique((high << 32) | low, return_inverse=True)[1]


def _suffixes(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, groups): the places whose first words repeat, in the order of their
    suffixes, and where a new first rank begins among them. At least the words that
    matter for ``level`` are compared before places are left out."""
    n = len(ids)
    rank, h = ids.astype(np.int64) + 1, 1
    while 2 * h <= level:  # whole ranks; beyond the end there is a word below all
        rank = _ranks(rank, np.concatenate([rank[h:], np.zeros(min(h, n), np.int64)])[:n]) + 1
        h *= 2
    size = np.bincount(rank)
    begin = np.cumsum(size) - size  # a rank's slot: its first place in the whole order
    slot = begin[rank]
    live = np.flatnonzero(size[rank] > 1)
    live = live[np.argsort(slot[live], kind="stable")]
    order, groups = live, slot[live]
    slot = np.append(slot, -1)
    left = live
    place = np.arange(len(live))  # where the open ones stand in the order
    while len(left):
        key = (slot[left] << 32) | (slot[np.minimum(left + h, n)] + 1)
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        order[place] = left
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        head = np.concatenate([[True], key[first][1:] >> 32 != key[first][:-1] >> 32])
        # the first slot of the old group, moved by the members before the new one
        at = np.maximum.accumulate(np.where(head, first, 0))
        moved = (key[first] >> 32) + first - at
        count = np.diff(np.append(first, len(left)))
        slot[left] = np.repeat(moved, count)
        still = np.repeat(count > 1, count)
        left, place = left[still], place[still]
        h *= 2
    return order, groups


def _lcp(ids: list[int], order: list[int], groups: list[int], level: int) -> list[int]:
    """LCP of each place in the order with the one before it (0 where a group begins).
    A suffix shares all but one word of what the one before it in the text shares."""
    n, before, out = len(ids), {}, {}
    for k in range(1, len(order)):
        if groups[k] == groups[k - 1]:
            before[order[k]] = order[k - 1]
    last, h = -2, 0
    for i in sorted(before):
        j = before[i]
        h = h - 1 if i == last + 1 and h > 0 else 0
        most = n - max(i, j)
        while h < most and ids[i + h] == ids[j + h]:
            h += 1
        out[i], last = h, i
    return [out.get(i, 0) for i in order]


def find_runs(ids: list[int], spec: RunSpec) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of small whole numbers,
    by start and period."""
    n, level = len(ids), spec.level
    if n < spec.min_length:
        return []
    at, groups = _suffixes(np.array(ids, np.int64), level)
    if not len(at):
        return []
    order = at.tolist()
    lcp = _lcp(ids, order, groups.tolist(), level)
    edges = sorted((k for k in range(1, len(order)) if lcp[k] >= level), key=lambda k: -lcp[k])
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    runs, k = [], 0
    while k < len(edges):
        shared, met = lcp[edges[k]], []
        while k < len(edges) and lcp[edges[k]] == shared:
            a, b = root(order[edges[k] - 1]), root(order[edges[k]])
            k += 1
            big, small = places.pop(a, [a]), places.pop(b, [b])
            if len(big) < len(small):
                a, b, big, small = b, a, small, big
            parent[b] = a
            if len(small) * 8 < len(big):
                for x in small:
                    insort(big, x)
                places[a] = both = big
            else:
                places[a] = both = sorted(big + small)  # two ordered stretches, merged in one pass
            new = set(small)
            for x in small:
                p = bisect_left(both, x)
                for i, j in ((p - 1, p), (p, p + 1)):
                    if i >= 0 and j < len(both) and (both[i] not in new or both[j] not in new):
                        i, j = both[i], both[j]
                        q = j - i
                        if q <= shared and shared + q >= max(spec.times * q, spec.min_length) and (i == 0 or ids[i - 1] != ids[j - 1]):
                            met.append((i, j))
        for i, j in met:  # still neighbours once all edges of the level are taken?
            both = places[root(i)]
            if both[bisect_left(both, i) + 1] == j:
                runs.append((i, shared + j - i, j - i))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, deep in zip(words, np.cumsum(edge).tolist(), strict=False) if not deep]


def plant_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the texts (by the crc32 of their ids) with a period
    planted: from word a on, word i becomes word a + (i - a) % p."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def detect(docs: DataFrame, spec: RunSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
           rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period in words, by start and period)
    and collapsed, the text's words without what any run repeats after its first
    period, a space between them. Words are separated by space and 0x09 to 0x0D and
    equal if their bytes are; ``rewrite`` changes a row's words before they are used."""
    spec = spec or RunSpec()
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def work(batches):
        for b in batches:
            size, found, kept = [], [], []
            for key, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                if rewrite is not None:
                    words = rewrite(key, words)
                numbers: dict[bytes, int] = {}
                runs = find_runs([numbers.setdefault(w, len(numbers)) for w in words], spec)
                size.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(found, pa.list_(run_type)),
                                              pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return rows.mapInArrow(tidy(work), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of what ``detect`` gives: the number of runs, the run with the greatest exact
    length / period (ties: smallest start, then period) and SHA-256 digests."""
    order = ("case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1"
             " when x.start <> y.start then sign(x.start - y.start) else sign(x.period - y.period) end")
    best = F.expr(f"get(array_sort(runs, (x, y) -> cast({order} as int)), 0)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (found.withColumn("best", best)
                 .select(F.col("id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                         F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
                         F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))

"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the short test items that stand inside long documents: |Q & X| / |Q| >= t
for the item's word shingles Q and the document's X. Items are partitioned by
size (powers of two). The sketch of an item is its bottom-k MinHash: the k
shingles with the smallest hash, k = |Q| - ceil(t |Q|) + 1, so it follows the
item's size and not the document's. A document that contains t of an item can
miss at most k - 1 of its shingles, hence it holds one of the sketch: no item is
missed, however long the document. A partition whose items need more shingles
than the document has is skipped. Each candidate is verified by exact shingle
containment in the same pass.

Documents are read once and not shuffled. The benchmark side is sent to the
tasks in blocks of about ``max_shingles`` (its size is checked; a larger
benchmark takes several blocks, each a pass over the documents).

Words: lower case, runs of letters and digits (other characters separate). An
item of fewer words than a shingle has its whole sequence as its one shingle, and
is looked for as that sequence.

Nulls: null or empty documents and items match nothing; a null id is carried.
Repeated rows match each. Extra columns pass through ``drop``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import blocks as B
from playlens.llm.common import prepare, stored, tidy


@dataclass(frozen=True)
class DecontamSpec:
    words: int = 5
    num: int = 80
    den: int = 100
    max_shingles: int = 2_000_000


#: Separators outside ASCII (quotation marks, dashes, ellipsis, wide spaces).
_OUTER = "[ «»‐-―‘-‟…‹›　-。]"


def normalised(col: pa.Array) -> pa.Array:
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.replace_substring_regex(pc.utf8_lower(col.fill_null("")), _OUTER, " ")


def _item_rows(spec: DecontamSpec):
    schema = pa.schema([("item", pa.int64()), ("width", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            ids, width, grams = [], [], []
            items = b.column("item").to_pylist()
            for i, _, h, counts in B.word_blocks(normalised(b.column("text")), B.PUNCT):
                s, n = B.shingles(h, counts, spec.words)
                for t, part in enumerate(np.split(s, np.cumsum(n)[:-1])):
                    if len(part):
                        ids.append(items[i + t])
                        width.append(min(spec.words, int(counts[t])))
                        grams.append(np.unique(part).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(width, pa.int32()),
                                              pa.array(grams, pa.list_(pa.int64()))], schema=schema)

    return run


class Index:
    """The items of one block, by shingle width and size partition."""

    def __init__(self, rows: list, spec: DecontamSpec):
        self.items = [r[0] for r in rows]
        self.grams = [np.sort(np.array(r[2], np.int64).view(np.uint64)) for r in rows]
        self.need = np.array([(spec.num * len(g) + spec.den - 1) // spec.den for g in self.grams])
        self.parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        by: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault((r[1], len(self.grams[i]).bit_length()), []).append(i)
        for (width, _), members in sorted(by.items()):
            keys, owner = [], []
            for i in members:
                g = self.grams[i]
                k = len(g) - int(self.need[i]) + 1
                sketch = g[np.argsort(B.mix(g))[:k]]
                keys.append(sketch)
                owner.append(np.full(len(sketch), i))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            least = int(min(self.need[i] for i in members))
            self.parts.setdefault(width, []).append((least, keys[order], owner[order]))

    def matches(self, col: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(place, item index, shingles in common, first word, last word + 1)."""
        for i, j, h, counts in B.word_blocks(normalised(col), B.PUNCT):
            for width, parts in self.parts.items():
                s, n = B.shingles(h, counts, width)
                ends = np.cumsum(n)
                pairs: set[tuple[int, int]] = set()
                for least, keys, owner in parts:
                    lo = np.searchsorted(keys, s, "left")
                    hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == s))
                    if not len(hit):
                        continue
                    text = np.searchsorted(ends, hit, "right")
                    big = n[text] >= least
                    hit, text = hit[big], text[big]
                    first, last = lo[hit], np.searchsorted(keys, s[hit], "right")
                    run = last - first
                    flat = np.repeat(first - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
                    pairs.update(zip(np.repeat(text, run).tolist(), owner[flat].tolist(), strict=True))
                for t, item in sorted(pairs):
                    own = s[ends[t] - n[t]:ends[t]]
                    g = self.grams[item]
                    at = np.minimum(np.searchsorted(g, own), len(g) - 1)
                    inside = g[at] == own
                    common = len(np.unique(at[inside]))
                    if common >= self.need[item]:
                        where = np.flatnonzero(inside)
                        yield i + t, item, common, int(where[0]), int(where[-1]) + width


def _indexes(items: DataFrame, spec: DecontamSpec, item_col: str, text_col: str) -> Iterator:
    spark = items.sparkSession
    prepare(spark)
    rows = stored(items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
                       .mapInArrow(tidy(_item_rows(spec)), "item long, width int, grams array<long>"), "items")
    total = rows.agg(F.sum(F.size("grams"))).first()[0] or 0
    n = -(-total // spec.max_shingles)
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "grams"), F.lit(n)) == block)
        yield spark.sparkContext.broadcast(Index(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0], r[2])), spec))


def find(docs: DataFrame, items: DataFrame, spec: DecontamSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found: id_col, item_col, n_item, n_common,
    containment, first_word, end_word (span in words of the document)."""
    spec = spec or DecontamSpec()
    schema = f"{id_col} long, {item_col} long, n_item long, n_common long, containment double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for index in _indexes(items, spec, item_col, item_text):
        def run(batches, index=index):
            x = index.value
            for b in batches:
                ids = b.column("id").to_pylist()
                rows = [(ids[p], x.items[q], len(x.grams[q]), c, c / len(x.grams[q]), lo, hi)
                        for p, q, c, lo, hi in x.matches(b.column("text"))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, pa.float64() if k == 4 else pa.int64()) for k, v in enumerate(zip(*rows, strict=True))],
                        names=[id_col, item_col, "n_item", "n_common", "containment", "first_word", "end_word"])

        out = out.unionByName(texts.mapInArrow(tidy(run), schema))
    return out


def drop(docs: DataFrame, items: DataFrame, spec: DecontamSpec | None = None, text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    spec = spec or DecontamSpec()
    for index in _indexes(items, spec, item_col, item_text):
        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[p for p, *_ in index.value.matches(b.column(text_col))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs

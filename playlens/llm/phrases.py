"""Phrase collocation mining by direct-address tiles.

Words are counted per language. The frequent ones of a language get ids by falling
count, and the square of pairs of ids is cut into tiles of ``tile`` x ``tile``
cells. A task holds back the pairs it sees and counts tile by tile: a tile with
enough pairs is one dense ``numpy.bincount`` over its cells, no sort; a sparse tile,
and pairs with a word outside the ids, are sorted coordinates with counts (COO).
The partial counts are summed by Spark per phrase.

Recursively, the frequent pairs of a language are ranked by their counts anew and
take the place of the left word: phrases of three words are cells (pair, word), and
so on up to ``max_words``. Only phrases whose two shorter parts are frequent are
counted, as no phrase is more frequent than its parts; nothing that can reach
``min_count`` is left out.

What a task gets besides its texts is bounded: ids for at most ``head_words`` words
or phrases of a language and ``head_all`` of all languages, and a bitmap of the
frequent ones of at most ``bitmap_bits`` bits, which only saves work: where it is
full, more is counted and the result stays the same. Memory does not follow the
longest text, which is read in slices.

A word of a language is known by 64 bits of its hash; should two frequent ones of
one hash meet, the words are counted again with another seed. Products are decimals
of 38 digits: exact up to 10**15 occurrences of a phrase.

Nulls: a null text has no words, a null language is ``und``. Empty texts and empty
tables give no phrase. Repeated rows count each. Ties are broken by count, then by
the phrase in byte order. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import blocks as B
from playlens.llm.common import bitmap, first_rows, in_bitmap, prepare, stored, tidy

U64 = np.uint64


@dataclass(frozen=True)
class PhraseSpec:
    max_words: int = 3  # 2 or 3
    min_count: int = 10
    #: A phrase goes if a longer one around it has this share of its count, in percent.
    inside: int = 50
    top: int = 2000
    tile: int = 512
    head_words: int = 4096
    head_all: int = 1 << 18
    bitmap_bits: int = 1 << 27
    #: A tile is dense if a task holds one pair for this many cells.
    sparse: int = 16
    #: Pairs that a task holds back before it counts them.
    held: int = 1 << 20


#: Characters that end a piece, and all that end a word.
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[[10, 11, 12, 13]] = True
SEP = BREAK.copy()
SEP[[0x20, 9]] = True


def _slices(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first text, bytes, begins of the texts, continued): whole texts, about a
    block at a time; a longer text comes alone, cut at separators."""
    raw, off = B.text_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + B.BLOCK, "right")) - 1))
        if off[j] - off[i] > 2 * B.BLOCK:
            at, end = int(off[i]), int(off[j])
            while at < end:
                to = min(end, at + B.BLOCK)
                while to < end and not SEP[raw[to]]:
                    to += 1
                yield i, raw[at:to], np.zeros(1, np.int64), at > off[i]
                at = to
        elif off[j] > off[i]:
            yield i, raw[off[i]:off[j]], off[i:j] - off[i], False
        i = j


def _chain(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The code of a phrase from the code of all but its last word, and that word's."""
    return B.mix(left * U64(0x9E3779B97F4A7C15) + word)


def _lang_codes(langs: pa.Array, seed: int) -> np.ndarray:
    known = pc.dictionary_encode(langs)
    codes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in known.dictionary.to_pylist()] or [0], np.uint64)
    return codes[known.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(langs) else codes[:0]


def _words(b: pa.RecordBatch, seed: int, keep: int) -> Iterator[tuple]:
    """(word codes, whether a word follows the one before in its piece, words carried
    over from the slice before, first text, bytes, begins of the texts, places of the
    new words); ``keep`` words are carried from slice to slice of a long text."""
    langs = _lang_codes(b.column("lang"), seed)
    carry = (np.zeros(0, np.uint64), np.zeros(0, bool))
    open_piece = False
    for i, raw, begins, continued in _slices(b.column("text")):
        h, starts = B._hash_words(raw, begins, SEP)
        text = np.searchsorted(begins, starts, "right") - 1
        codes = B.mix(h ^ langs[i + text])
        breaks = np.cumsum(BREAK[raw], dtype=np.int64)
        link = np.zeros(len(codes), bool)
        link[1:] = (breaks[starts[1:]] == breaks[starts[:-1]]) & (text[1:] == text[:-1])
        if not continued:
            carry, open_piece = (carry[0][:0], carry[1][:0]), False
        elif len(codes):
            link[0] = open_piece and breaks[starts[0]] == 0
        if len(codes):
            open_piece = bool(breaks[-1] == breaks[starts[-1]])
        else:
            open_piece = open_piece and not breaks[-1]
        skip = len(carry[0])
        codes, link = np.concatenate([carry[0], codes]), np.concatenate([carry[1], link])
        yield codes, link, skip, i, raw, begins, starts
        carry = (codes[len(codes) - min(keep, len(codes)):], link[len(link) - min(keep, len(link)):])


def _word_rows(seed: int):
    schema = pa.schema([("code", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])

    def run(batches):
        seen: dict[int, list] = {}

        def send():
            if seen:
                lang, word, c = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64)), pa.array(lang, pa.string()),
                                                  pa.array(word, pa.string()), pa.array(c, pa.int64())], schema=schema)
                seen.clear()

        for b in batches:
            langs = b.column("lang")
            for codes, _, _, i, raw, begins, starts in _words(b, seed, 0):
                if not len(codes):
                    continue
                distinct, first, c = np.unique(codes, return_index=True, return_counts=True)
                new = [k for k, x in enumerate(distinct.tolist()) if x not in seen]
                if new:
                    at = starts[first[new]]
                    seps = np.flatnonzero(SEP[raw])
                    ends = np.append(seps, len(raw))[np.searchsorted(seps, at)]
                    text = np.searchsorted(begins, at, "right") - 1
                    ends = np.minimum(ends, np.append(begins, len(raw))[text + 1])
                    low = B.FOLD[raw].tobytes()
                    for k, s, e, t in zip(new, at.tolist(), ends.tolist(), text.tolist(), strict=True):
                        seen[int(distinct[k])] = [langs[i + t].as_py(), low[s:e].decode("utf-8", "replace"), 0]
                for x, m in zip(distinct.tolist(), c.tolist(), strict=True):
                    seen[x][2] += m
                if len(seen) > 1 << 17:
                    yield from send()
        yield from send()

    return run


def _count_words(texts: DataFrame, spec: PhraseSpec) -> tuple[DataFrame, DataFrame, int]:
    """(every language with its number of words, the frequent words: code, lang,
    word, f; the seed of the codes)."""
    for seed in range(8):
        rows = texts.mapInArrow(tidy(_word_rows(seed)), "code long, lang string, word string, c long")
        every = stored(rows.groupBy("code", "lang", "word").agg(F.sum("c").alias("f")), "words")
        words = stored(every.where(F.col("f") >= spec.min_count), "frequent-words")
        if not words.groupBy("code").count().where("count > 1").take(1):
            return every.groupBy("lang").agg(F.sum("f").alias("n")), words, seed
    raise RuntimeError("words of equal hash under every seed")


@dataclass
class Head:
    """The ranked ones: sorted codes, their language's number, rank and word codes."""
    codes: np.ndarray
    slot: np.ndarray
    rank: np.ndarray
    parts: np.ndarray

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those without a rank."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)


def _head(rows: DataFrame, parts: list[str], slots: dict[str, int], spec: PhraseSpec) -> Head:
    """Ranks by falling count within each language, of a bounded number of rows."""
    best = (first_rows(rows.select(*dict.fromkeys(["code", "lang", "f", *parts])), "lang", [F.desc("f"), F.col("code")], spec.head_words, "r")
                .orderBy(F.desc("f"), "code").limit(spec.head_all).select("code", "lang", "r", *parts).collect())
    codes = np.array([x["code"] for x in best], np.int64).view(np.uint64)
    for x in best:
        slots.setdefault(x["lang"], len(slots))
    at = np.argsort(codes)
    table = np.array([[x[p] for p in parts] for x in best], np.int64).reshape(len(best), len(parts)).view(np.uint64)
    return Head(codes[at], np.array([slots[x["lang"]] for x in best], np.int64)[at], np.array([x["r"] - 1 for x in best], np.int64)[at], table[at])


def _sized_bitmap(rows: DataFrame, spec: PhraseSpec) -> np.ndarray:
    n = rows.count()
    bits = 1 << 20
    while bits < min(spec.bitmap_bits, 16 * n):
        bits *= 2
    return bitmap(rows, "code", bits)


class Tiles:
    """Pairs (left, word) of ranked ones, counted tile by tile."""

    def __init__(self, left: Head, right: Head, spec: PhraseSpec):
        self.left, self.right, self.spec = left, right, spec
        self.side = -(-spec.head_words // spec.tile)
        self.cells = spec.tile * spec.tile
        self.by_place = [self._places(h) for h in (left, right)]
        self.held, self.size = [], 0
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def _places(self, h: Head) -> np.ndarray:
        """Head entries by language and rank."""
        out = np.full((int(h.slot.max(initial=-1)) + 1) * self.side * self.spec.tile, -1, np.int64)
        out[h.slot * self.side * self.spec.tile + h.rank] = np.arange(len(h.slot))
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        t = self.spec.tile
        ra, rb = self.left.rank[a], self.right.rank[b]
        tile = (self.left.slot[a] * self.side + ra // t) * self.side + rb // t
        self.held.append(tile * self.cells + (ra % t) * t + rb % t)
        self.size += len(a)
        if self.size >= self.spec.held:
            self.count()

    def count(self) -> None:
        if not self.size:
            return
        keys = np.concatenate(self.held)
        tile = keys // self.cells
        per = np.bincount(tile)
        if len(per) <= 1 << 16:
            tile = tile.astype(np.uint16)  # sorted by radix
        keys = keys[np.argsort(tile, kind="stable")]
        cut = np.cumsum(per) - per
        out, rest = [], []
        for k in np.flatnonzero(per):
            part = keys[cut[k]:cut[k] + per[k]]
            if per[k] * self.spec.sparse >= self.cells:
                dense = np.bincount(part - k * self.cells, minlength=self.cells)
                cell = np.flatnonzero(dense)
                out.append((cell + k * self.cells, dense[cell]))
            else:
                rest.append(part)
        if rest:
            out.append(np.unique(np.concatenate(rest), return_counts=True))
        self.done.extend(out)
        self.held, self.size = [], 0
        k, c = np.concatenate([x for x, _ in self.done]), np.concatenate([x for _, x in self.done])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        self.done = [(k[first], np.add.reduceat(c, first))]

    def rows(self, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(word codes, counts) of all that was counted, if more than ``most``."""
        if not self.done or len(self.done[0][0]) <= most:
            return None
        k, c = self.done[0]
        self.done = []
        t = self.spec.tile
        tile, cell = k // self.cells, k % self.cells
        slot, ta, tb = tile // (self.side * self.side), tile // self.side % self.side, tile % self.side
        a = self.by_place[0][(slot * self.side + ta) * t + cell // t]
        b = self.by_place[1][(slot * self.side + tb) * t + cell % t]
        return np.column_stack([self.left.parts[a], self.right.parts[b]]), c


def _sorted_counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates: distinct rows and how often each stands there. (Rows whose
    mixed keys clash may come out in several parts, which Spark sums.)"""
    key = rows[:, 0]
    for j in range(1, rows.shape[1]):
        key = _chain(key, rows[:, j])
    rows = rows[np.argsort(key)]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.diff(np.append(first, len(rows)))


def _gram_rows(n: int, seed: int, shared, spec: PhraseSpec):
    """Partial counts (g1 .. gn, c) of the n-word phrases whose parts are frequent."""
    schema = pa.schema([(f"g{k + 1}", pa.int64()) for k in range(n)] + [("c", pa.int64())])

    def batch(rows: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(n)]
                                          + [pa.array(c.astype(np.int64))], schema=schema)

    def run(batches):
        frequent, left, right = shared.value
        tiles = Tiles(left, right, spec)
        loose, size = [], 0
        for b in batches:
            for codes, link, skip, *_ in _words(b, seed, n - 1):
                if len(codes) < n:
                    continue
                whole = link.copy()  # the n words that end here stand in one piece
                whole[:n - 1] = False
                part = codes  # the code of the n - 1 words that end here
                for k in range(1, n - 1):
                    whole[k:] &= link[:-k]
                    part = np.concatenate([part[:1], _chain(part[:-1], codes[1:])])
                whole[:skip] = False
                ok = in_bitmap(frequent, part)
                at = np.flatnonzero(whole & ok)
                at = at[ok[at - 1]]
                a, w = left.find(part[at - 1]), right.find(codes[at])
                ranked = (a >= 0) & (w >= 0)
                tiles.add(a[ranked], w[ranked])
                at = at[~ranked]
                if len(at):
                    loose.append(np.column_stack([codes[at - n + 1 + k] for k in range(n)]))
                    size += len(at)
                    if size >= spec.held:
                        yield batch(*_sorted_counts(np.concatenate(loose)))
                        loose, size = [], 0
                out = tiles.rows(spec.held)
                if out:
                    yield batch(*out)
        tiles.count()
        out = tiles.rows(0)
        if out:
            yield batch(*out)
        if loose:
            yield batch(*_sorted_counts(np.concatenate(loose)))

    return run


def _coded(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the code of their n words."""
    names = [*rows.columns, "code"]

    def run(batches):
        for b in batches:
            g = [b.column(f"g{k + 1}").to_numpy().view(np.uint64) for k in range(n)]
            code = g[0]
            for x in g[1:]:
                code = _chain(code, x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.view(np.int64))], names=names)

    return rows.mapInArrow(tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", code long")


def _score(a, left, right):
    """floor(1,000,000 a a / (left right)) in decimals."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
                  f" div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")


def collocations(docs: DataFrame, spec: PhraseSpec | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank (from 1), phrase, a (its
    count), l and r (the counts of the two parts of its lowest-scoring cut, the
    earliest among equals), n (words of the language) and score."""
    spec = spec or PhraseSpec()
    if spec.max_words not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    totals, words, seed = _count_words(texts, spec)
    totals = stored(totals, "totals")
    slots: dict[str, int] = {}
    right = _head(words, ["code"], slots, spec)
    named = words.select("code", "word", "f")

    def counted(n: int, frequent: DataFrame, left: Head) -> DataFrame:
        shared = spark.sparkContext.broadcast((_sized_bitmap(frequent, spec), left, right))
        cols = [f"g{k + 1}" for k in range(n)]
        rows = texts.mapInArrow(tidy(_gram_rows(n, seed, shared, spec)), ", ".join(f"{c} long" for c in cols) + ", c long")
        return rows.groupBy(*cols).agg(F.sum("c").alias("a")).where(F.col("a") >= spec.min_count)

    first = words.select(F.col("code").alias("g1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    last = named.select(F.col("code").alias("g2"), F.col("word").alias("w2"), F.col("f").alias("f2"))
    pairs = stored(_coded(counted(2, words, right).join(first, "g1").join(last, "g2"), 2), "pairs")
    found = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "g1", "g2")
    found = found.withColumn("score", _score("a", "l", "r"))
    if spec.max_words == 3:
        left = _head(pairs.withColumn("f", F.col("a")), ["g1", "g2"], slots, spec)
        inner = pairs.select("g1", "g2", F.col("a").alias("a12"), "lang", "w1", "w2", "f1")
        outer = pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("a23"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
        three = stored(counted(3, pairs, left).join(inner, ["g1", "g2"]).join(outer, ["g2", "g3"]), "triples")
        three = three.withColumns({"s1": _score("a", "f1", "a23"), "s2": _score("a", "a12", "f3")})
        late = F.col("s2") < F.col("s1")
        covers = three.select(F.explode(F.array(F.struct("g1", "g2", F.col("a12").alias("own")),
                                                F.struct(F.col("g2").alias("g1"), F.col("g3").alias("g2"), F.col("a23").alias("own")))).alias("x"), "a")
        covers = covers.where(F.col("a").cast("decimal(19,0)") * 100 >= F.col("x.own").cast("decimal(19,0)") * spec.inside).select("x.g1", "x.g2").distinct()
        found = found.join(covers, ["g1", "g2"], "left_anti").drop("g1", "g2").unionByName(
            three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                         F.when(late, F.col("a12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("a23")).alias("r"),
                         F.least("s1", "s2").alias("score")))
    best = first_rows(found, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], spec.top, "rank")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

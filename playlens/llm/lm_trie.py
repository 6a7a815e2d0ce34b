"""LM scoring: an Elias-Fano n-gram trie in memory-mapped levels.

The trie is cut into shards by the hash range of an n-gram's first word. A shard
has one file per level in the shared folder:

    level 1   word hashes (Elias-Fano), exact counts, back-off weights
    level k   for each context in order its children's word ids, coded as
              context place * ids + word id, so that one monotone sequence holds
              them all (Elias-Fano); monotone pointers to the first child of each
              context; quantised smoothed probabilities and back-off weights

A word of a text is looked up in level 1, an n-gram in level k by a successor
search relative to its context's place in level k - 1: the pointers of that place
give the range of its children, and only that range is searched. Tasks map the
files; a batch's queries are sorted, so a level is read in one sweep forward and the
pointers are read once per context.

Probabilities: interpolated absolute discounting over the add-one unigram model.
All counts are of the whole training part; n-grams of two words and more seen
fewer than ``min_count`` times are not stored, their mass stays with the back-off
weight, so every context's probabilities still sum to one (up to the quantising
step of 1/256 in log10).

Counting: a task counts its own n-grams, and sends each shard one packed row of
sorted keys and counts (delta-coded, zstd). The number of shards follows the
text. Nothing passes through the driver but one row per shard.

Nulls: a null text is an empty text (its one token is the end); a null id is hashed
as ''. Repeated rows count each. Without training rows the model knows nothing
and N = V = 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import blocks as B
from playlens.llm import shared_files as files
from playlens.llm.common import prepare, stored
from playlens.llm.elias_fano import EliasFano, encode
from playlens.llm.packed import ROWS_SQL, Counter, gather

_TYPES = (np.uint8, np.uint16, np.uint64, np.int64)
#: N-grams smoothed at a time.
_SLICE = 1 << 18


@dataclass(frozen=True)
class TrieSpec:
    order: int = 2
    min_count: int = 2
    discount: float = 0.75
    step: float = 1 / 256  # of a probability's log10
    shard_chars: int = 1 << 25

    def __post_init__(self):
        if self.order not in (1, 2, 3):
            raise ValueError("order is 1, 2 or 3")


def _pack(parts: dict[str, np.ndarray]) -> np.ndarray:
    """Arrays in one byte array, each at a multiple of 8."""
    head, body, at = [], [], 0
    for name, a in parts.items():
        code = next(i for i, t in enumerate(_TYPES) if a.dtype == t)
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1)
        head.append(f"{name}:{code}:{at}:{len(raw)}")
        raw = np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)])
        body.append(raw)
        at += len(raw)
    text = ";".join(head).encode()
    text += b" " * (-len(text) % 8)
    return np.concatenate([np.frombuffer(len(text).to_bytes(8, "little") + text, np.uint8), *body])


def _unpack(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for item in raw[8:8 + size].tobytes().decode().strip().split(";"):
        name, code, at, length = item.split(":")
        lo = 8 + size + int(at)
        out[name] = raw[lo:lo + int(length)].view(_TYPES[int(code)])
    return out


def _sub(parts: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix):]: v for k, v in parts.items() if k.startswith(prefix)}


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and words per text of a batch."""
    h, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, hashes, counts in B.word_blocks(col):
        h.append(hashes)
        n.append(counts)
    return np.concatenate(h), np.concatenate(n)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, by a hash table: only distinct values are sorted."""
    codes = pa.array(x).dictionary_encode()
    values = codes.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return values[order], place[codes.indices.to_numpy()]


def _order(x: np.ndarray) -> np.ndarray:
    """The places of ``x`` in ascending order, equal values by place: one plain sort of the
    values with their places where both fit in 64 bits, several times faster than argsort."""
    bits = max(len(x) - 1, 1).bit_length()
    if not len(x) or (int(x.max()) - int(x.min())).bit_length() + bits > 64:
        return np.argsort(x, kind="stable")
    both = (x - x.min()).astype(np.uint64) << np.uint64(bits)
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, by ``_order``."""
    order = _order(x)
    x = x[order]
    new = np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], back


@dataclass
class Trie:
    """What a task needs to open the shards: a folder and one entry per shard."""
    folder: str
    spec: TrieSpec
    bounds: np.ndarray  # hash limits of the shards (one fewer than shards)
    offsets: np.ndarray  # first word id of each shard, and the number of words
    tokens: int = 0  # N
    types: int = 0  # V, the end included
    docs: int = 0
    level_offsets: dict | None = None  # level -> first node of each shard

    def __post_init__(self):
        self._open = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    @property
    def end(self) -> int:
        return int(self.offsets[-1])

    @property
    def ids(self) -> int:
        """Word ids: the words, the end and the beginning."""
        return self.end + 2

    def shard(self, level: int, s: int) -> dict:
        if (level, s) not in self._open:
            p = _unpack(np.asarray(files.load(self.folder, f"level{level}-{s}")))  # mapped, as plain arrays
            self._open[level, s] = {**p, "ef": EliasFano(_sub(p, "ef.")), **({"ptr": EliasFano(_sub(p, "ptr."))} if level > 1 else {})}
        return self._open[level, s]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct word hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        cut = np.concatenate([[0], np.searchsorted(hashes, self.bounds), [len(hashes)]])
        for s in range(len(self.offsets) - 1):
            lo, hi = cut[s], cut[s + 1]
            if hi > lo and self.offsets[s + 1] > self.offsets[s]:
                at, ok = self.shard(1, s)["ef"].successor(hashes[lo:hi])
                out[lo:hi] = np.where(ok, at + self.offsets[s], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Exact counts of sorted ids (end included; the beginning has none)."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.offsets)
        for s in range(len(self.offsets) - 1):
            if cut[s + 1] > cut[s]:
                out[cut[s]:cut[s + 1]] = self.shard(1, s)["counts"][ids[cut[s]:cut[s + 1]] - self.offsets[s]]
        out[ids == self.end] = self.docs
        return out

    def unigram_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def sequence(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids with one beginning and end per text, -1 unknown; places of the
        tokens; tokens per text; sorted distinct hashes' ids; their place per word)."""
        h, n = _words(col)
        distinct, back = _distinct(h)
        known = self.word_ids(distinct)
        first = np.cumsum(n + 2) - (n + 2)
        seq = np.empty(len(h) + 2 * len(n), np.int64)
        tokens = np.ones(len(seq), bool)
        seq[first] = self.end + 1
        tokens[first] = False
        seq[first + n + 1] = self.end
        inner = np.ones(len(seq), bool)
        inner[first] = inner[first + n + 1] = False
        seq[inner] = known[back]
        return seq, np.flatnonzero(tokens), n + 1, known, back

    def find(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Nodes of ``level`` for keys (node of the context * ids + word id) in the order of
        their contexts, -1 where there is none. The pointers give each distinct context the range of its
        children, and the word is searched in that range."""
        out = np.full(len(keys), -1, np.int64)
        base, here = self._node_offsets(level - 1), self.level_offsets[level]
        cut = np.searchsorted(keys, base.astype(np.uint64) * np.uint64(self.ids))
        cut[-1] = len(keys)
        for s in range(len(base) - 1):
            if cut[s + 1] > cut[s] and here[s + 1] > here[s]:
                p, x = self.shard(level, s), keys[cut[s]:cut[s + 1]] - np.uint64(int(base[s]) * self.ids)
                place = (x // np.uint64(self.ids)).astype(np.int64)
                new = np.concatenate([[True], place[1:] != place[:-1]])
                runs = np.diff(np.concatenate([np.flatnonzero(new), [len(x)]]))
                lo, hi = p["ptr"].spans(place[new])
                at = p["ef"].within(x, np.repeat(lo, runs), np.repeat(hi, runs))
                out[cut[s]:cut[s + 1]] = np.where(at >= 0, at + here[s], -1)
        return out

    def _node_offsets(self, level: int) -> np.ndarray:
        if level > 1:
            return self.level_offsets[level]
        off = self.offsets.copy()
        off[-1] = self.ids  # the end and the beginning belong to the last shard
        return off

    def stored(self, level: int, name: str, nodes: np.ndarray, file_level: int | None = None) -> np.ndarray:
        """log10 values of ``nodes`` (shards in order) from a quantised array."""
        out = np.zeros(len(nodes))
        off = self._node_offsets(level)
        cut = np.searchsorted(nodes, off)
        for s in range(len(off) - 1):
            if cut[s + 1] > cut[s]:
                codes = self.shard(file_level or level, s).get(name)
                if codes is not None and len(codes):
                    out[cut[s]:cut[s + 1]] = -self.spec.step * codes[nodes[cut[s]:cut[s + 1]] - off[s]].astype(np.float64)
        return out

    def children(self, level: int, node: int) -> np.ndarray:
        """Word ids that follow a node of ``level``, in order, by the monotone pointers."""
        off = self._node_offsets(level)
        s = int(np.searchsorted(off, node, "right")) - 1
        p = self.shard(level + 1, s)
        place = node - int(off[s])
        lo, hi = p["ptr"].spans(np.array([place]))
        return (p["ef"].access(np.arange(lo[0], hi[0])) - np.uint64(place * self.ids)).astype(np.int64)

    def node_word(self, nodes: np.ndarray) -> np.ndarray:
        """The last word of sorted level 2 nodes."""
        out = np.zeros(len(nodes), np.int64)
        off = self.level_offsets[2]
        cut = np.searchsorted(nodes, off)
        for s in range(len(off) - 1):
            if cut[s + 1] > cut[s]:
                value = self.shard(2, s)["ef"].access(nodes[cut[s]:cut[s + 1]] - off[s])
                out[cut[s]:cut[s + 1]] = (value % np.uint64(self.ids)).astype(np.int64)
        return out

    def lower(self, level: int, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of ``word`` one order below, after contexts that are
        nodes of ``level`` - 1: without context for level 2, after the node's last
        word for level 3."""
        def unigram(w):
            u, back = _unique(w)
            return self.unigram_log10(self.counts(u))[back]

        if level == 2:
            return unigram(word)
        nodes, at = _unique(ctx)
        last = self.node_word(nodes)[at]
        keys, at = _unique(last.astype(np.uint64) * np.uint64(self.ids) + word.astype(np.uint64))
        node = self.find(2, keys)
        p = np.full(len(keys), np.nan)
        p[node >= 0] = self.stored(2, "prob", node[node >= 0])
        p = p[at]
        none = np.isnan(p)
        if none.any():
            p[none] = unigram(word[none]) + self.gathered(1, "back", last[none], 2)
        return p

    def gathered(self, level: int, name: str, nodes: np.ndarray, file_level: int | None = None) -> np.ndarray:
        """``stored`` for nodes in any order, -1 giving 0."""
        u, back = _unique(nodes)
        ok = u >= 0
        values = np.zeros(len(u))
        values[ok] = self.stored(level, name, u[ok], file_level)
        return values[back]

    def log10(self, seq: np.ndarray, uni: np.ndarray, top: int | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of every place of ``seq`` given what stands before it
        in its text; ``uni`` the unigram log10, ``after`` the weights of the words as
        contexts where the caller has them."""
        score = uni.copy()
        begins = seq == self.end + 1
        last = top or self.spec.order
        if last < 2 or len(seq) < 2:
            return score
        if after is None:
            after = self.gathered(1, "back", np.where(seq >= 0, seq, -1), 2)
        # places that follow a known word, that word and its weight as a context
        place = np.flatnonzero((seq[:-1] >= 0) & ~begins[1:]) + 1
        ctx, weight = seq[place - 1], after[place - 1]
        for level in range(2, last + 1):
            score[place] += weight
            # contexts without stored children have weight 0 (log10 of one)
            ask = np.flatnonzero((weight < 0) & (seq[place] >= 0))
            place, ctx = place[ask], ctx[ask]
            keys = ctx.astype(np.uint64) * np.uint64(self.ids) + seq[place].astype(np.uint64)
            if level == 2 or level < last:
                order = _order(keys)
                place, keys = place[order], keys[order]
            if level == last:  # few repeats: each place by itself, in the order of the contexts
                at = self.find(level, keys)
                ok = at >= 0
                score[place[ok]] = self.stored(level, "prob", at[ok])
                break
            new = np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
            at = self.find(level, keys[new])
            ok = at >= 0
            p, weights = self.stored(level, "prob", at[ok]), self.stored(level, "back", at[ok], level + 1)
            runs = np.diff(np.concatenate([np.flatnonzero(new), [len(keys)]]))
            place, runs = place[np.repeat(ok, runs)], runs[ok]
            score[place] = np.repeat(p, runs)
            # the places after these, still in the order of their contexts
            place, ctx, weight = place + 1, np.repeat(at[ok], runs), np.repeat(weights, runs)
            inner = place < len(seq)
            inner[inner] = ~begins[place[inner]]
            place, ctx, weight = place[inner], ctx[inner], weight[inner]
        return score


def train(docs: DataFrame, spec: TrieSpec | None = None, text_col: str = "text") -> Trie:
    """Count and write the trie of the rows of ``docs``."""
    spec = spec or TrieSpec()
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    # a level above the second holds up to twice the n-grams of the one below
    shards = max(4, -(-(chars or 0) * max(1, spec.order - 1) // spec.shard_chars))
    bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    folder = files.new_folder(spark, "trie")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))

    def count_words(batches):
        held = Counter(bounds)
        for b in batches:
            yield from held.add(_words(b.column("text"))[0])
        yield from held.send()

    def first_level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = key[0].as_py()
        k, c = gather(b.filter(b.column("n").is_valid()) for b in batches)
        parts = {f"ef.{n}": a for n, a in encode(k, 1 << 64).items()}
        files.save(folder, f"level1-{s}", _pack({**parts, "counts": c}))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())],
                                         names=["shard", "nodes", "total"])

    def by_shard(sent: DataFrame, write) -> list:
        # one row per shard comes to the driver
        got = stored(every.join(sent, "shard", "left").groupBy("shard").applyInArrow(write, "shard int, nodes long, total long"), "shards")
        return sorted(map(tuple, got.collect()))

    first = by_shard(texts.mapInArrow(count_words, ROWS_SQL), first_level)
    sizes = np.array([n for _, n, _ in first], np.int64)
    trie = Trie(folder, spec, bounds, np.concatenate([[0], np.cumsum(sizes)]), tokens=sum(t for *_, t in first) + rows,
                types=int(sizes.sum()) + (1 if rows else 0), docs=rows, level_offsets={})

    for level in range(2, spec.order + 1):
        base = trie._node_offsets(level - 1)
        shared = spark.sparkContext.broadcast(trie)  # one entry per shard
        done = by_shard(texts.mapInArrow(_count_level(level, base, shared), ROWS_SQL), _write_level(level, base, shared))
        trie.level_offsets[level] = np.concatenate([[0], np.cumsum([n for _, n, _ in done])]).astype(np.int64)
    return trie


def _count_level(level: int, base: np.ndarray, shared):
    """A task's counts of (context node, word id) keys."""
    def count(batches):
        t = shared.value
        held = Counter(base[1:-1].astype(np.uint64) * np.uint64(t.ids))
        for b in batches:
            seq = t.sequence(b.column("text"))[0]
            node, keys, ask = seq, None, None
            for k in range(2, level + 1):
                ctx = np.concatenate([[-1], node[:-1]])
                ctx[seq == t.end + 1] = -1
                ask = np.flatnonzero((ctx >= 0) & (seq >= 0))
                keys = ctx[ask].astype(np.uint64) * np.uint64(t.ids) + seq[ask].astype(np.uint64)
                if k < level:
                    order = _order(keys)
                    keys, ask = keys[order], ask[order]
                    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
                    node = np.full(len(seq), -1, np.int64)
                    node[ask] = np.repeat(t.find(k, keys[first]), np.diff(np.append(first, len(keys))))
            yield from held.add(keys)
        yield from held.send()

    return count


def _write_level(level: int, base: np.ndarray, shared):
    """Merge a shard's counts, smooth, quantise and write the level's file."""
    def write(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s = shared.value, key[0].as_py()
        spec = t.spec
        k, c = gather(b.filter(b.column("n").is_valid()) for b in batches)
        k = k - np.uint64(int(base[s]) * t.ids)
        ctx = (k // np.uint64(t.ids)).astype(np.int64)
        contexts = int(base[s + 1] - base[s])
        total = np.bincount(ctx, weights=c, minlength=contexts)
        keep = c >= spec.min_count
        k, c, ctx = k[keep], c[keep], ctx[keep]
        word = (k - ctx.astype(np.uint64) * np.uint64(t.ids)).astype(np.int64)
        own = (c - spec.discount) / total[ctx]
        back = 1 - np.bincount(ctx, weights=own, minlength=contexts)
        del c, keep, total

        def quantised(x):
            return np.minimum(np.rint(-np.log10(np.maximum(x, 1e-250)) / spec.step), 65535).astype(np.uint16)

        prob = np.empty(len(k), np.uint16)
        for lo in range(0, len(k), _SLICE):  # the look-ups below hold many arrays of their size
            at = slice(lo, lo + _SLICE)
            prob[at] = quantised(own[at] + back[ctx[at]] * 10.0 ** t.lower(level, ctx[at] + int(base[s]), word[at]))
        del own, word
        # code 0: no stored child; else at least one step
        codes = np.where(np.bincount(ctx, minlength=contexts) > 0, np.maximum(quantised(back), 1), 0).astype(np.uint16)
        starts = np.searchsorted(ctx, np.arange(contexts + 1)).astype(np.uint64)
        parts = {f"ef.{n}": a for n, a in encode(k, max(1, contexts * t.ids)).items()}
        parts |= {f"ptr.{n}": a for n, a in encode(starts, len(k) + 1).items()}
        files.save(t.folder, f"level{level}-{s}", _pack({**parts, "prob": prob, "back": codes}))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([0], pa.int64())],
                                         names=["shard", "nodes", "total"])

    return write


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, n_known, base_score (add-one
    unigram) and score (the trie's log10 probability of the whole text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # one entry per shard
    schema = f"{id_col} long, n_tokens long, n_known long, base_score double, score double"

    def run(batches):
        t = shared.value
        for b in batches:
            seq, places, size, known, back = t.sequence(b.column("text"))
            counts = np.zeros(len(known), np.int64)
            # distinct words come sorted by hash, so their known ids are sorted
            counts[known >= 0] = t.counts(known[known >= 0])
            per_type = t.unigram_log10(counts)
            uni = np.full(len(seq), t.unigram_log10(np.array([t.docs]))[0])
            inner = (seq != t.end + 1) & (seq != t.end)
            uni[inner] = per_type[back]
            seen = np.ones(len(seq), np.int64) * (t.docs > 0)
            seen[inner] = (counts > 0)[back]
            begin = np.cumsum(size) - size
            after = None
            if t.spec.order > 1:  # once per distinct word, not per place
                after = np.zeros(len(seq))
                weights = np.zeros(len(known))
                weights[known >= 0] = t.stored(1, "back", known[known >= 0], 2)
                after[inner] = weights[back]
                edges = t.stored(1, "back", np.array([t.end, t.end + 1]), 2)
                after[seq == t.end], after[seq == t.end + 1] = edges
            full = t.log10(seq, uni, after=after)
            sums = [np.add.reduceat(x[places], begin) if len(begin) else x[:0] for x in (seen, uni, full)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size.astype(np.int64)), pa.array(sums[0].astype(np.int64)),
                                              pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())],
                                             names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)

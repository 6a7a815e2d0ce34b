"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is folded to lower case; its subwords are the byte n-grams of 2 to 4 bytes
inside words (word edges included), hashed into ``buckets``. The text's vector is
the mean of its subwords' embeddings, the output a softmax over a linear layer.
Both are trained by stochastic gradient descent in numpy, in one task, on a
bounded sample: at most ``max_docs`` labelled rows per language, whole texts, and
of each a random span of words as well, so that short texts are known too.

A fifth of the sample is held back to calibrate: a temperature for the softmax,
and the confidence below which a prediction is rejected (at most ``max_reject``
of the rightly recognised held-back texts fall below it, and it is never above
one half).

As mean and output are linear, prediction needs one table of ``buckets`` x
languages: about 1 MB for 8 languages, whatever the input.

Nulls: null text, or text without a letter, is ``und`` with score 0 and is not
accepted. Rows with a null label are not learned from. With no labelled row at
all every text is ``und``. Tied scores go to the language first in order.
Repeated rows are predicted each. Extra columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from playlens.llm.blocks import BLOCK, PUNCT, text_buffers
from playlens.llm.common import prepare, release, stored, tidy
from playlens.llm.sampling import bounded_sample


@dataclass(frozen=True)
class LangSpec:
    buckets: int = 1 << 15
    dim: int = 16
    sizes: tuple[int, ...] = (2, 3, 4)
    max_docs: int = 500
    epochs: int = 6
    rate: float = 20.0
    max_reject: float = 0.002
    seed: int = 11


_SPLIT = PUNCT.copy()


def features(raw: np.ndarray, spec: LangSpec) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first byte) of every subword of a byte array in lower case."""
    sep = _SPLIT[raw]
    x = np.where(sep, np.uint8(32), raw).astype(np.uint32)
    out, at = [], []
    for n in spec.sizes:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, 0x811C9DC5 ^ n, np.uint32)
        for j in range(n):
            h = (h ^ x[j:len(x) - n + 1 + j]) * np.uint32(0x01000193)
        inner = np.zeros(len(h), bool)
        for j in range(1, n - 1):
            inner |= sep[j:len(x) - n + 1 + j]
        inner |= sep[:len(h)] & sep[n - 1:]  # at least one byte of a word, not an edge alone
        ok = np.flatnonzero(~inner)
        h = h[ok]
        out.append((h ^ (h >> np.uint32(15))) % np.uint32(spec.buckets))
        at.append(ok)
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def _bag(text: bytes, spec: LangSpec) -> tuple[np.ndarray, np.ndarray]:
    raw, count = np.frombuffer(text, np.uint8), np.zeros(spec.buckets, np.int64)
    edge = np.full(1, 32, np.uint8)
    for lo, hi in _cuts(raw, 0, len(raw)):
        idx, _ = features(np.concatenate([edge, raw[lo:hi], edge]), spec)
        count += np.bincount(idx, minlength=spec.buckets)
    u = np.flatnonzero(count).astype(np.uint32)
    return u, (count[u] / max(1, count.sum())).astype(np.float32)


def _cuts(raw: np.ndarray, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Slices of about a block that end at word edges."""
    while at < end:
        to = min(end, at + BLOCK)
        while to < end and not _SPLIT[raw[to]]:
            to += 1
        yield at, to
        at = to


def fit(texts: Iterable[str], langs: list[str], spec: LangSpec) -> dict | None:
    """Train and calibrate; None without a text. Of the texts, read one by one, only
    the bags of subwords are kept."""
    rng = np.random.default_rng(spec.seed)
    names = sorted(set(langs))
    if not names:
        return None
    bags = []
    for t, lang in zip(texts, langs, strict=True):
        low, y = t.lower(), names.index(lang)
        bags.append((*_bag(low.encode("utf-8", "replace"), spec), y))
        words = low.split()
        if len(words) > 4:
            n = int(rng.integers(2, min(60, len(words))))
            k = int(rng.integers(0, len(words) - n))
            bags.append((*_bag(" ".join(words[k:k + n]).encode("utf-8", "replace"), spec), y))
    bags = [b for b in bags if len(b[0])]
    if not bags:
        return None
    order = rng.permutation(len(bags))
    held = [bags[i] for i in order[:len(bags) // 5]]
    train = [bags[i] for i in order[len(bags) // 5:]]
    E = rng.uniform(-1, 1, (spec.buckets, spec.dim)).astype(np.float32) / spec.dim
    W = np.zeros((spec.dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = spec.epochs * len(train), 0
    for _ in range(spec.epochs):
        for i in rng.permutation(len(train)):
            u, w, y = train[i]
            lr = spec.rate * (1 - done / steps)
            done += 1
            v = w @ E[u]
            z = v @ W + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = W @ p
            W -= 0.05 * lr * np.outer(v, p)
            bias -= 0.001 * lr * p
            E[u] -= lr * w[:, None] * back
    table = (E @ W).astype(np.float32)
    held = held or train
    Z = np.array([w @ table[u] + bias for u, w, _ in held])
    Y = np.array([y for *_, y in held])

    def softmax(T: float) -> np.ndarray:
        z = Z / T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(T)[np.arange(len(Y)), Y], 1e-12)).mean() for T in grid]
    T = float(grid[int(np.argmin(loss))])
    p = softmax(T)
    right = p.argmax(axis=1) == Y
    sure = p.max(axis=1)[right]
    limit = min(0.5, float(np.quantile(sure, spec.max_reject))) if right.any() else 0.0
    return {"names": names, "table": table, "bias": bias, "temperature": T, "limit": limit}


def train(docs: DataFrame, spec: LangSpec | None = None, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id") -> dict | None:
    """Fit on a bounded sample of ``docs`` (rows that may be learned from)."""
    spec = spec or LangSpec()
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # ids first, so that only the sample's texts are moved
    ids = stored(bounded_sample(known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), "lang", "id", spec.max_docs), "lang-sample")
    sample = (known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                   .join(F.broadcast(ids.distinct()), ["id", "lang"], "left_semi"))  # bounded by max_docs per language

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("lang", "ascending"), ("id", "ascending"), ("text", "ascending")])
        model = fit((x.as_py() for x in t.column("text")), t.column("lang").to_pylist(), spec)
        del t
        release()
        return pa.table({"m": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(one, "m binary").collect()
    return pickle.loads(bytes(rows[0][0])) if rows else None


def _sums(col: pa.Array, model: dict, spec: LangSpec) -> tuple[np.ndarray, np.ndarray]:
    """Summed outputs and number of subwords of each text."""
    raw, off = text_buffers(pc.utf8_lower(col))
    n, k = len(off) - 1, len(model["names"])
    total, count = np.zeros((n, k)), np.zeros(n)
    table = model["table"]
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1))
        if off[j] - off[i] > BLOCK:  # one long text, slice by slice (each from a word edge)
            for at, to in _cuts(raw, int(off[i]), int(off[j])):
                idx, _ = features(np.concatenate([[np.uint8(32)], raw[at:to], [np.uint8(32)]]).astype(np.uint8), spec)
                total[i] += table[idx].sum(axis=0, dtype=np.float64)
                count[i] += len(idx)
        elif off[j] > off[i]:
            # one edge between texts: each text is followed by a separator
            lens = np.diff(off[i:j + 1])
            buf = np.full(int(off[j] - off[i]) + (j - i) + 1, 32, np.uint8)
            owner = np.repeat(np.arange(j - i), lens)
            buf[1 + np.arange(len(owner)) + owner] = raw[off[i]:off[j]]
            idx, at = features(buf, spec)
            ends = np.cumsum(lens + 1)  # a subword belongs to the text in which its first byte, or the edge before it, lies
            who = np.minimum(np.searchsorted(ends, at, "right"), j - i - 1)
            for c in range(k):
                total[i:j, c] = np.bincount(who, weights=table[idx, c], minlength=j - i)
            count[i:j] = np.bincount(who, minlength=j - i)
        i = j
    return total, count


def predict(docs: DataFrame, model: dict | None, spec: LangSpec | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (calibrated probability) and accepted (which
    replace extra columns of these names)."""
    spec = spec or LangSpec()
    docs = docs.drop("lang_pred", "score", "accepted")
    prepare(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array(m["names"], dtype=object)
        for b in batches:
            col = b.column(text_col)
            if not pa.types.is_large_string(col.type):
                col = col.cast(pa.large_string())
            col = col.fill_null("")
            letters = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
            total, count = _sums(col, m, spec)
            z = (total / np.maximum(count, 1)[:, None] + m["bias"]) / m["temperature"]
            p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            p = p / p.sum(axis=1, keepdims=True) if len(z) else p
            best = p.argmax(axis=1) if len(z) else np.zeros(0, int)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            lang = np.where(letters, names[best], "und")
            out = b.append_column("lang_pred", pa.array(list(lang), pa.string()))
            out = out.append_column("score", pa.array(score, pa.float64()))
            yield out.append_column("accepted", pa.array(letters & (score >= m["limit"]), pa.bool_()))

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("accepted", BooleanType())])
    return docs.mapInArrow(tidy(run), schema)

"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled text: a word is a term if it stands in toxic
texts after far more different words than in the others (a one-sided binomial
test over distinct preceding words, corrected for the number of words; copies of
one passage count once). Misspelled terms are found by running a word through the
product of the lexicon trie and a Levenshtein automaton, determinised as words
come: a state is the set of (trie node, edits) still possible, and its moves are
kept, so most words end in the empty state after a few characters. Words that
clean training texts use are not taken for misspellings.

Each hit gets an abuse weight from its window of characters: less inside
quotation marks or after a colon with quotation marks (quotation), more with
other hits near (abuse). A logistic regression on the sums and densities of these
weights, trained on the same labelled sample, gives the score.

Training takes at most ``max_toxic`` and ``max_clean`` labelled rows (a bounded
sample by hash of the id), whole texts. Scores cover every whole text and use the
text alone.

Nulls: a null or empty text has no hit; its score is that of a text without hits.
Null labels are not learned from. Without labelled rows, or without a term, every
text gets the share of toxic labels. Repeated rows are scored each. Extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import prepare, stored
from playlens.llm.sampling import bounded_sample

#: Words may hold an obfuscating character between letters.
_WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
_QUOTES = "\"“”„«»‘’"


@dataclass(frozen=True)
class ToxSpec:
    max_toxic: int = 3000
    max_clean: int = 6000
    level: float = 0.01  # chance that any clean word becomes a term
    min_support: int = 4
    short: int = 5  # terms shorter than this are matched exactly
    long: int = 10  # terms of this length allow two edits
    window: int = 60  # characters on each side


def edits(term: str, spec: ToxSpec) -> int:
    return 0 if len(term) < spec.short else 1 if len(term) < spec.long else 2


@dataclass
class Lexicon:
    """A trie of the terms and the automaton determinised on demand."""
    weights: dict[str, float]
    spec: ToxSpec
    clean: frozenset[str] = frozenset()
    _moves: dict = field(default_factory=dict)

    def __post_init__(self):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that any term below a node allows
        for t in sorted(self.weights):
            n, e = 0, edits(t, self.spec)
            self.most[0] = max(self.most[0], e)
            for ch in t:
                if ch not in self.child[n]:
                    self.child[n][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.most.append(0)
                n = self.child[n][ch]
                self.most[n] = max(self.most[n], e)
            self.term[n] = t
        self.start = self._closed({0: 0})
        self._memo: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self):
        return {"weights": self.weights, "spec": self.spec, "clean": self.clean}

    def __setstate__(self, state):
        self.__init__(**state)

    def _closed(self, state: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """With the term's characters that may be left out."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e + 1 <= self.most[n] and state.get(n, 99) > e + 1:
                    state[n] = e + 1
                    todo.append((n, e + 1))
        return tuple(sorted(state.items()))

    def _move(self, state: tuple, ch: str) -> tuple:
        key = (state, ch)
        got = self._moves.get(key)
        if got is None:
            new: dict[int, int] = {}

            def reach(n: int, e: int) -> None:
                if e <= self.most[n] and new.get(n, 99) > e:
                    new[n] = e

            for node, e in state:
                reach(node, e + 1)  # an extra character
                for c, n in self.child[node].items():
                    reach(n, e if c == ch else e + 1)
            if len(self._moves) > 200_000:
                self._moves.clear()
            got = self._moves[key] = self._closed(new)
        return got

    def lookup(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, None without one in reach."""
        if word in self._memo:
            return self._memo[word]
        state, found = self.start, None
        for ch in word:
            state = self._move(state, ch)
            if not state:
                break
        else:
            ends = [(e, self.term[n]) for n, e in state if self.term[n] and e <= edits(self.term[n], self.spec)]
            if ends:
                e, term = min(ends)
                if e == 0 or word not in self.clean:
                    found = (term, e)
        if len(self._memo) > 400_000:
            self._memo.clear()
        self._memo[word] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, term, edits, quoted) of every hit."""
        low = text.lower()
        if not any(map(self.lookup, set(_WORD.findall(low)))):
            return []
        if len(low) != len(text):
            text = low  # case folding moved the places
        out = []
        for m in _WORD.finditer(low):
            got = self.lookup(m.group())
            if got:
                out.append((m.start(), m.end(), *got, self._quoted(text, m.start(), m.end())))
        return out

    def _quoted(self, text: str, a: int, b: int) -> bool:
        before, after = text[max(0, a - self.spec.window):a], text[b:b + self.spec.window]
        before = before[before.rfind("\n") + 1:]
        after = after.split("\n", 1)[0]
        opened = sum(before.count(q) for q in _QUOTES if q not in "‘’")
        closes = any(q in after for q in _QUOTES if q not in "‘’")
        return opened % 2 == 1 and closes

    def features(self, text: str | None) -> list[float]:
        """hits, abuse, strongest window, hits per 100 words, misspelled, quoted share."""
        found = self.hits(text) if text else []
        if not found:
            return [0.0] * 6
        w = self.spec.window
        abuse, best = 0.0, 0.0
        for i, (a, _, term, e, quoted) in enumerate(found):
            near = sum(1 for j in (i - 1, i + 1) if 0 <= j < len(found) and abs(found[j][0] - a) <= w)
            value = self.weights[term] * (0.25 if quoted else 1.0) * (0.8 ** e) * (1 + 0.25 * near)
            abuse += value
            best = max(best, value)
        words = max(1, len(text) // 6)
        return [math.log1p(len(found)), math.log1p(abuse), best, min(10.0, 100 * len(found) / words),
                sum(e > 0 for *_, e, _ in found) / len(found), sum(q for *_, q in found) / len(found)]


def _word_rows(batches):
    """Distinct (word, preceding word, label) of a batch."""
    schema = pa.schema([("word", pa.string()), ("before", pa.string()), ("toxic", pa.int32())])
    for b in batches:
        rows: set[tuple[str, str, int]] = set()
        for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = _WORD.findall((t or "").lower())
            rows.update(zip(words, ["", *words], [y] * len(words), strict=False))
        if rows:
            w, p, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(p), pa.array(y, pa.int32())], schema=schema)


def _tail(n: int, k: int, q: float) -> float:
    """P(at least k of n) for a share q."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log1p(-q) for i in range(k, n + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs)


@dataclass
class Model:
    lexicon: Lexicon
    coef: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), 6)
        z = ((x - self.mean) / self.scale) @ self.coef + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 0.5)
    ridge[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def train(docs: DataFrame, labels: DataFrame, spec: ToxSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic), which hold only rows
    that may be learned from."""
    spec = spec or ToxSpec()
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    ids = stored(bounded_sample(known.where("toxic = 1"), "toxic", "id", spec.max_toxic)
                 .unionByName(bounded_sample(known.where("toxic = 0"), "toxic", "id", spec.max_clean)), "tox-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(ids), "id"), "tox-texts")  # at most max_toxic + max_clean ids
    words = stored(sample.mapInArrow(_word_rows, "word string, before string, toxic int").distinct()
                         .groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "tox-words")
    n, pos, neg = words.agg(F.count(F.lit(1)), F.sum("pos"), F.sum("neg")).first()
    weights: dict[str, float] = {}
    if pos and neg:
        q = pos / (pos + neg)
        # a term must be well above the common share; bounded by the sample's words
        for w, p, m in words.where((F.col("pos") >= spec.min_support) & (F.col("pos") > (F.col("pos") + F.col("neg")) * F.lit(max(0.8, (1 + q) / 2)))).collect():
            if _tail(p + m, p, q) < spec.level / n:
                weights[w] = math.log((p + 0.5) / (m + 0.5) * (1 - q) / q)
    top = max(weights.values(), default=1.0)
    lexicon = Lexicon({w: v / top for w, v in weights.items()}, spec)

    def near(batches):
        for b in batches:
            out = sorted({w for w in b.column("word").to_pylist() if w not in lexicon.weights and lexicon.lookup(w)})
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    clean = [r[0] for r in words.where("neg > 0 and neg >= pos").select("word").mapInArrow(near, "word string").collect()]
    lexicon = Lexicon(lexicon.weights, spec, frozenset(clean))

    def rows(batches):
        for b in batches:
            f = [lexicon.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(f, pa.list_(pa.float64()))], names=["toxic", "f"])

    got = sample.select("text", "toxic").mapInArrow(rows, "toxic int, f array<double>").collect()  # bounded by the sample
    y = np.array([r[0] for r in got], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        z = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(lexicon, np.zeros(6), z, np.zeros(6), np.ones(6))
    x = np.array([r[1] for r in got]).reshape(len(y), 6)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive doesn't matter
    coef, bias, mean, scale = _logistic(x[order], y[order])
    return Model(lexicon, coef, bias, mean, scale)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            s = m.score(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"{id_col} long, score double, predicted int")

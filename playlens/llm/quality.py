"""Quality classifier: interpolated modified Kneser-Ney character n-grams.

The model is trained on trusted text (rows labelled good). Counts, continuation
counts and the three discounts are grouped and joined by Spark, sharded by the
n-gram's context; the finished probabilities are written as sorted shards into
the shared folder. Scoring joins each block's distinct n-grams with the shards
by a sorted merge and gives every whole text its perplexity per character. Per
language, a text above a quantile of the perplexity of trusted texts that the
model was not trained on is rejected.

Four in five trusted rows (by hash of the id) train the model, whole texts of any
length; ``max_docs`` can bound their number per language, which by default nothing
does. Thresholds use all other trusted rows: a model knows the texts it was trained
on, so these can't say how new good text scores. Scores cover every text in full. A
language with
fewer than ``min_support`` such rows uses the threshold of all languages
together.

Nulls: a null or empty text has a null perplexity and is rejected. A null
language is a language of its own. Rows without label are scored alike. Without
any trusted row nothing can be compared: every text with a character is kept,
its perplexity is null. Repeated rows are scored each. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from playlens.llm import shared_files as files
from playlens.llm.blocks import BLOCK
from playlens.llm.common import aside, prepare, stored, tidy
from playlens.llm.sampling import bounded_sample


@dataclass(frozen=True)
class QualitySpec:
    order: int = 4  # at most 4: a character takes 16 of a key's 64 bits
    max_docs: int | None = None
    quantile: float = 0.998
    min_support: int = 50
    shards: int = 8


def _codes(text: str, pad: int) -> np.ndarray:
    """Code points folded to 16 bits and shifted past the pad symbol 0."""
    u = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    u = np.minimum((u & np.uint64(0xFFFF)) ^ (u >> np.uint64(16)), np.uint64(0xFFFE)) + np.uint64(1)
    return np.concatenate([np.zeros(pad, np.uint64), u])


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The key of the n-gram that ends at each position from n - 1 on."""
    g = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        g = (g << np.uint64(16)) | codes[j:len(codes) - n + 1 + j]
    return g


def _slices(text: str, n: int):
    """The keys of a text's n-grams, by the slice of the text they end in."""
    for lo in range(0, len(text), BLOCK):
        keep = min(n - 1, lo)
        yield _grams(_codes(text[lo - keep:lo + BLOCK], n - 1 - keep), n)


def _count_rows(spec: QualitySpec):
    schema = pa.schema([("gram", pa.int64()), ("c", pa.int64())])

    def counted(keys):
        k, c = np.unique(np.concatenate(keys), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], schema=schema)

    def run(batches):
        for b in batches:
            keys, held = [], 0
            for x in b.column("text"):
                for part in _slices(x.as_py() or "", spec.order):
                    keys.append(part)
                    held += len(part)
                    if held >= BLOCK:
                        yield counted(keys)
                        keys, held = [], 0
            if keys:
                yield counted(keys)

    return run


def train(texts: DataFrame, spec: QualitySpec) -> str | None:
    """Fit on the column ``text``; the folder of the model's shards, None without text.

    For each order n the table (gram, ctx, suffix, c) holds counts (highest order)
    or continuation counts; joins on ctx give totals and the back-off weight,
    joins on suffix the lower order's probability.
    """
    spark = texts.sparkSession
    counts = (texts.mapInArrow(tidy(_count_rows(spec)), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    tables = {spec.order: stored(counts, "kn-counts")}
    for n in range(spec.order - 1, 0, -1):
        # N1+(. g): in how many left contexts g is seen
        low = F.col("gram").bitwiseAND(F.lit((1 << (16 * n)) - 1))
        tables[n] = stored(tables[n + 1].groupBy(low.alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    vocabulary = tables[1].count()
    if not vocabulary:
        return None
    folder = files.new_folder(spark, "kn-model")
    lower = None
    for n in range(1, spec.order + 1):
        t = tables[n].withColumn("ctx", F.expr("shiftrightunsigned(gram, 16)"))
        c1, c2, c3, c4 = (tables[n].agg(*[F.sum((F.col("c") == k).cast("int")) for k in (1, 2, 3, 4)]).first())
        y = c1 / (c1 + 2 * c2) if c1 and c2 else 0.5
        cut = [min(max(k - (k + 1) * y * hi / lo, 0.1), k - 0.01) if lo and hi else 0.75 * k
               for k, lo, hi in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
        d = F.when(F.col("c") == 1, cut[0]).when(F.col("c") == 2, cut[1]).otherwise(cut[2])
        sums = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(d).alias("mass"))
        sums = sums.withColumn("gamma", F.col("mass") / F.col("total"))
        p = t.join(sums, "ctx").withColumn("own", (F.col("c") - d) / F.col("total"))
        if n == 1:
            p = p.withColumn("p", F.col("own") + F.col("gamma") / F.lit(vocabulary + 1))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = p.withColumn("suffix", suffix).join(below, "suffix").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        lower = stored(p.select("gram", "p"), "kn-prob")
        _write(lower.select(F.col("gram").alias("key"), F.log10("p").alias("v")), folder, f"p{n}", spec.shards)
        _write(sums.select(F.col("ctx").alias("key"), F.log10("gamma").alias("v")), folder, f"g{n}", spec.shards)
    return folder


def _write(rows: DataFrame, folder: str, name: str, shards: int) -> None:
    """Sorted (key, value) shards by hash of the key, one file pair each."""
    def put(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        k = t.column("key").to_numpy().view(np.uint64)
        order = np.argsort(k)
        files.save(folder, f"{name}-{key[0].as_py()}-k", k[order])
        files.save(folder, f"{name}-{key[0].as_py()}-v", t.column("v").to_numpy()[order].astype(np.float32))
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    # an empty shard gets a file as well
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    sent = every.join(placed, "shard", "left").where("key is not null").groupBy("shard").applyInArrow(put, "n long")
    sent.agg(F.sum("n")).collect()


class Scorer:
    """The shards of a model, opened once per task."""

    def __init__(self, folder: str, spec: QualitySpec):
        self.folder, self.spec, self.open = folder, spec, {}

    def _join(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Values of sorted distinct keys, NaN where the shards have none."""
        out = np.full(len(keys), np.nan)
        if name not in self.open:
            parts = []
            for s in range(self.spec.shards):
                try:
                    parts.append((files.load(self.folder, f"{name}-{s}-k"), files.load(self.folder, f"{name}-{s}-v")))
                except FileNotFoundError:  # no key fell into this shard
                    continue
            self.open[name] = parts
        for k, v in self.open[name]:
            at = np.searchsorted(k, keys)
            hit = at < len(k)
            hit[hit] = k[at[hit]] == keys[hit]
            out[hit] = v[at[hit]]
        return out

    def log10(self, grams: np.ndarray, n: int) -> np.ndarray:
        """log10 probability of sorted distinct n-grams."""
        got = self._join(f"p{n}", grams)
        miss = np.isnan(got)
        if miss.any():
            if n == 1:
                got[miss] = self._join("g1", np.zeros(1, np.uint64))[0] - np.log10(len_vocabulary(self) + 1)
                return got
            low = grams[miss]
            ctx, back = np.unique(low >> np.uint64(16), return_inverse=True)
            gamma = np.nan_to_num(self._join(f"g{n}", ctx), nan=0.0)[back]
            suffix, at = np.unique(low & np.uint64((1 << (16 * (n - 1))) - 1), return_inverse=True)
            got[miss] = gamma + self.log10(suffix, n - 1)[at]
        return got

    def perplexities(self, texts: list[str]) -> np.ndarray:
        """Perplexity per character of each text (not empty)."""
        n = self.spec.order
        keys = [_grams(_codes(t, n - 1), n) for t in texts]
        size = np.array([len(k) for k in keys])
        grams, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.add.reduceat(self.log10(grams, n)[at], np.cumsum(size) - size)
        return 10.0 ** (-total / size)


def len_vocabulary(s: Scorer) -> int:
    s._join("p1", np.zeros(0, np.uint64))
    return sum(len(k) for k, _ in s.open["p1"])


def _pieces(texts: list[str | None]):
    """Runs of places with at most a block of text; one long text comes alone."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if run and size + len(t) > BLOCK // 2:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(t)
    if run:
        yield run


def _long(s: Scorer, text: str) -> float:
    """Perplexity of one very long text, slice by slice."""
    n, total = s.spec.order, 0.0
    for keys in _slices(text, n):
        grams, c = np.unique(keys, return_counts=True)
        total += float((s.log10(grams, n) * c).sum())
    return float(10.0 ** (-total / len(text)))


def with_perplexity(docs: DataFrame, folder: str | None, spec: QualitySpec, text_col: str = "text", out: str = "perplexity") -> DataFrame:
    """``docs`` and their perplexity (double, null for null or empty text)."""
    if folder is None:
        return docs.withColumn(out, F.lit(None).cast("double"))

    def run(batches):
        scorer = Scorer(folder, spec)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            got = np.full(len(texts), np.nan)
            for run_ in _pieces(texts):
                if len(run_) == 1 and len(texts[run_[0]]) > BLOCK:
                    got[run_[0]] = _long(scorer, texts[run_[0]])
                else:
                    got[run_] = scorer.perplexities([texts[i] for i in run_])
            yield b.append_column(out, pa.array(got, pa.float64(), mask=np.isnan(got)))

    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def trusted_ids(docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """(id, lang) of rows labelled good."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).where("id is not null").distinct()
    return docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).distinct().join(good, "id")


def classify(docs: DataFrame, labels: DataFrame, spec: QualitySpec | None = None, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang", keep_columns: list[str] | None = None) -> DataFrame:
    """``keep_columns`` of docs (default: all) with perplexity, threshold and keep
    (which replace extra columns of these names)."""
    spec = spec or QualitySpec()
    prepare(docs.sparkSession)
    cols = [c for c in keep_columns or docs.columns if c not in ("perplexity", "threshold", "keep")]
    docs, back = aside(docs.select(*dict.fromkeys([*cols, id_col, lang_col, text_col])), [id_col, lang_col, text_col])
    back = back[:len(cols)]
    trusted = stored(trusted_ids(docs, labels, id_col, lang_col), "trusted")
    # a fifth of the trusted rows, at least, never trains the model
    may_train = trusted.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(5)) != 0)
    fit = stored(may_train if spec.max_docs is None else bounded_sample(may_train, "lang", "id", spec.max_docs), "trusted-fit")
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .join(fit.select("id").distinct(), "id", "left_semi").select("text"))
    folder = train(texts, spec)
    passed = list(dict.fromkeys([id_col, lang_col, *([text_col] if text_col in cols else []), "rest"]))
    said = F.length(text_col) > 0
    every = with_perplexity(docs, folder, spec, text_col, "__ppl").select(*passed, "__ppl", said.alias("__said"))
    if text_col in cols:
        # the thresholds need ids and languages alone; texts are scored again where
        # they are filtered, and no copy of them is written
        scored = stored(with_perplexity(docs.select(*dict.fromkeys([id_col, lang_col, text_col])), folder, spec, text_col, "__ppl")
                        .select(*dict.fromkeys([id_col, lang_col]), "__ppl"), "perplexity")
    else:
        every = scored = stored(every, "perplexity")
    held = (scored.where("__ppl is not null").select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), "__ppl")
                  .join(trusted.select("id").distinct(), "id", "left_semi")
                  .join(fit.select("id").distinct(), "id", "left_anti"))
    seen = held.select("lang", "__ppl")
    q = F.percentile_approx("__ppl", spec.quantile, 10_000)
    per_lang = seen.groupBy("lang").agg(q.alias("t"), F.count(F.lit(1)).alias("n"))
    # All languages together; where every trusted row trains, those rows' own.
    pooled = seen.agg(q.alias("t")).first()["t"]
    if pooled is None:
        inside = scored.where("__ppl is not null").join(fit.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
        pooled = inside.agg(q.alias("t")).first()["t"]
    limits = stored(per_lang.where(F.col("n") >= spec.min_support).select(F.col("lang").alias("__lang"), "t"), "thresholds")
    joined = every.join(limits, F.col(lang_col).eqNullSafe(F.col("__lang")), "left")
    threshold = F.coalesce("t", F.lit(pooled).cast("double"))
    keep = F.coalesce(F.col("__said"), F.lit(False)) & F.coalesce(F.col("__ppl") <= threshold, F.lit(True))
    return joined.select(*back, F.col("__ppl").alias("perplexity"), threshold.alias("threshold"), keep.alias("keep"))



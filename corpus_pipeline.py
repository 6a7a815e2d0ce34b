"""The corpus pipeline: documents that are worth training on.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet in the shared folder and hands it, read again, to
the next. All stages but the last return the columns of ``documents``.

1. quality: documents whose perplexity is above their language's threshold go.
2. language: documents whose language isn't recognised with confidence go.
3. near_duplicates: of each group of near copies (five words, 0.8) the document
   with the smallest id stays.
4. decontaminate: documents that hold a benchmark item go.
5. mix: documents are sampled to the target shares of source, language and topic.
   Returns doc_id, source, lang, topic, n_tokens and probability of the sample.

Defined results, at every stage:

* null id: the row is judged by its own text and never counts as a near copy;
* null or empty text: the quality stage drops the row; a text without a letter goes at
  the language stage; near_duplicates, decontaminate and mix keep such rows, which
  have no words, match no item and have no tokens;
* null language or source: a value of its own ('' for the mix);
* very long texts are read whole, in slices;
* repeated rows share every verdict but one: of equal texts with an id the first stays;
* ties: the smallest id stays; of rows of one id and one group the first by text;
* an empty table: every stage returns no row, with its columns;
* other columns pass through the first four stages as they are, whatever their names,
  those of the stages' own results included; the last returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import decontaminate as leaks
from playlens.llm import langid, mixing, ngram_join
from playlens.llm import quality as kn
from playlens.llm.common import aside, prepare, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = aside(docs, ["doc_id", "text", "lang"])
    return kn.classify(rows, labels).where("keep").select(*back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows, back = aside(docs, ["doc_id", "text", "lang"])
    return langid.predict(rows, langid.train(rows)).where("accepted").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return leaks.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = mixing.mix(docs).where("sampled")
    return kept.select("doc_id", "source", "lang", "topic", "n_tokens", "probability")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Trained classifiers decide in the first two stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

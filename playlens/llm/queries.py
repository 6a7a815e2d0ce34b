"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import (
    ann, chat, decontaminate, html_text, langid, lm_trie, mixing, ngram_join, periodic, phrases, quality, simhash, toxicity,
)
from playlens.llm.common import bucket_of, prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The text of both turns of the probe conversation -1.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.component_ids(docs, ngram_join.JoinSpec(words=4, num=85))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


#: Every n-gram of the training text up to three words, those seen once too.
LM = lm_trie.TrieSpec(order=3, min_count=1)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = bucket_of("doc_id", 7) == 2
    trie = lm_trie.train(docs.where(~held), LM)
    out = lm_trie.score(docs, trie)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_common", "containment")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = bucket_of("doc_id", 5) == 0
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return html_text.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = bucket_of("doc_id", 3) == 1
    model = langid.train(docs.where(~held))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, _table(spark, sf_dir, "labels"), keep_columns=["doc_id", "lang"])


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(docs)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.detect(docs, rewrite=periodic.plant_period))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_join": op2_ngram_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_lm_score": op4_lm_score,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_nearest": op8_nearest,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_simhash": op12_simhash,
    "op13_periodic_runs": op13_periodic_runs,
}

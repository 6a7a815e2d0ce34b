"""Nulls in every column, empty and long texts, repeated rows, empty tables and
extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from playlens.llm import chat, decontaminate, html_text, langid, lm_trie, mixing, ngram_join, quality, toxicity

SMALL = "/root/testdata/sf0.001"
#: Names that the operators give to columns of their own.
CLASHING = ("id", "n", "cls", "comp", "gram", "pos", "file", "tokens", "weight", "now", "topic", "label", "toxic", "keep", "h", "value",
            "__ppl", "__said", "__lang", "__source", "__topic", "__first", "__cls", "__comp", "rest", "t")
LONG = "the quick brown fox jumps over one lazy dog near a river bank " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(-1, None, "en", "s", 1), (-2, "", None, None, None), (-3, LONG, "en", "s", 1), (-3, LONG, "en", "s", 1),
       (None, "a row without an id that holds a few words", "en", None, 2), (-4, " \t\n", "en", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    both = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    return both.withColumns({c: F.lit(c) for c in CLASHING})


def bag(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def test_chat(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "", "x"), (None, 0, "user", "hi", "x"), (2, None, "user", LONG, "x"),
            (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(turns)
    assert out.where("not round_trip_ok").count() == 0
    assert {r["conv_id"]: r["n_turns"] for r in chat.digests(out).collect()}[3] == 2
    assert chat.digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_ngram_join(spark, docs):
    few = docs.where("doc_id < 40 or doc_id is null")
    got = {r["doc_id"]: r for r in ngram_join.component_ids(few).collect() if r["doc_id"] is not None}
    assert all(got[i]["n_shingles"] == 0 and got[i]["component_id"] == i for i in (-1, -2, -4))
    assert got[-3]["component_id"] == -3 and got[-3]["n_shingles"] == 13
    kept = ngram_join.keep_one(few)
    assert kept.columns == few.columns
    assert kept.where("doc_id = -3").count() == 1 and kept.where("doc_id is null").count() == 1
    assert ngram_join.component_ids(few.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs, mixing.MixSpec(rounds=2))
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (-1, -2, -4)} == {0}
    assert len({(r["probability"], r["sampled"]) for r in rows if r["doc_id"] == -3}) == 1


def test_trie(docs):
    few = docs.where("doc_id < 60 or doc_id is null")
    out = lm_trie.score(few, lm_trie.train(few)).collect()
    assert len(out) == few.count()
    assert {r["n_tokens"] for r in out if r["doc_id"] in (-1, -2, -4)} == {1}
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert lm_trie.score(few.limit(0), lm_trie.train(few.limit(0))).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over one lazy dog near a river", "x"), (2, None, "x"), (3, "", "x"),
                                   (None, "an item without an id and with some more words", "x"),
                                   (1, "quick brown fox jumps over one lazy dog near a river", "x")], "item_id long, text string, doc_id string")
    few = docs.where("doc_id < 40 or doc_id is null")
    found = decontaminate.find(few, items)
    assert {r["item_id"] for r in found.where("doc_id = -3").collect()} == {1}
    kept = decontaminate.drop(few, items)
    assert kept.columns == few.columns and kept.where("doc_id = -3").count() == 0
    assert bag(decontaminate.drop(few, items.limit(0)), "doc_id") == bag(few, "doc_id")
    assert decontaminate.find(few.limit(0), items).count() == 0


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").unionByName(
        spark.createDataFrame([(None, 1), (5, None), (-3, 0), (-3, 0)], "doc_id long, toxic int"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] in (-1, -2, -3, -4)} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_html(spark):
    rows = [(1, None, "u", "t"), (2, "", "u", "t"), (None, "<p>a", None, "t"), (4, "<div>" * 20000 + "deep", "u", "t"), (4, "<p>b</p>", "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    out = {(r["page_id"], r["html"]): r["text"] for r in html_text.extract(pages).collect()}
    assert [out[1, None], out[2, ""], out[None, "<p>a"], out[4, "<p>b</p>"]] == [None, "", "a", "b"]
    assert out[rows[3][:2]].strip() == "deep"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_language_id(docs):
    out = langid.predict(docs, langid.train(docs))
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert {r["lang_pred"] for r in out.where("doc_id in (-1, -2, -4)").collect()} == {"und"}


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(
        spark.createDataFrame([(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"))
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    assert out.where("doc_id in (-1, -2)").where("keep").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty, long and repeated rows; columns named like the stages' own results,
    of other types, come back as they were."""
    import corpus_pipeline as p
    from playlens.llm.common import stored

    own = ["perplexity", "threshold", "keep", "lang_pred", "score", "accepted", "n_tokens", "probability", "sampled", "component_id", "n_shingles"]
    base = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    docs = base.withColumns({c: F.lit(f"own {c}") for c in (*CLASHING, *own)}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    for name, stage in p.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL), f"odd-{name}")
        assert out.dtypes == docs.dtypes, name
        assert out.where(" or ".join(f"`{c}` is null or `{c}` <> 'own {c}'" for c in (*CLASHING, *own))).count() == 0
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert not {-1, -2} & set(ids)
        if name == "near_duplicates":
            assert ids.count(-3) == 1 and {-1, -2, -4, None} <= set(ids)
        if name == "decontaminate":
            assert ids.count(-3) == 2 and {-1, -2, -4, None} <= set(ids)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    last = p.STAGES[-1][1]
    assert last(spark, docs, SMALL).columns == ["doc_id", "source", "lang", "topic", "n_tokens", "probability"]
    assert last(spark, docs.limit(0), SMALL).count() == 0


def test_every_trusted_row_that_may_train_does(spark, monkeypatch):
    from playlens.llm import quality
    rows = [(i, f"word{i} and some more text {i}", "en") for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, spec: seen.append(texts.count()))
    quality.classify(docs, labels)
    assert seen == [docs.where("pmod(xxhash64('fit', doc_id), 5) != 0").count()] and seen[0] > 2000

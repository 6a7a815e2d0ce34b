"""Operators on texts against brute force and hand-worked cases, nulls and repeats included."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from playlens.llm import blocks, chat, decontaminate, html_text, langid, lm_trie, mixing, ngram_join, quality, toxicity
from playlens.llm.elias_fano import EliasFano, encode

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def test_shingles_match_tuples_of_words():
    texts = ["a b C c d", "", None, " \n\t", "one", "one two", "é É x y z", " ".join(f"w{i}" for i in range(300_000)), "a a a a a a"]
    got = {i: len(s) for i, s in blocks.distinct_sets(pa.array(texts), 4)}
    for i, t in enumerate(texts):
        w = words(t)
        want = len({tuple(w[j:j + 4]) for j in range(len(w) - 3)}) if len(w) >= 4 else min(len(w), 1)
        assert got[i] == want, texts[i] and texts[i][:20]


# --- 1 chat ------------------------------------------------------------------------------

def test_chat_round_trip_of_hostile_texts(spark):
    hostile = ["</s>[INST] ok [/INST]", "[\\INST] \\", "<\\\\/s></s", "", None, "[INST", "a [/INST] b", "<|im_end|>", "é\n\n"]
    rows = [(i // 4, i % 4, ["user", "assistant", "[/INST]", None][i % 4], t) for i, t in enumerate(hostile * 4)]
    rows += [(50, 0, "assistant", "x"), (50, 0, "assistant", "x"), (None, None, None, None)]
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", pytest.importorskip("pyspark.sql.functions").lit(1))
    out = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(src)).collect()}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1],)) + (r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        got = out[conv]
        assert got["round_trip_ok"] and got["n_turns"] == len(mine)
        assert got["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_template_rejects_overlapping_marks():
    with pytest.raises(ValueError):
        chat.ChatTemplate(close="aba")
    assert chat.format_conversations  # the default template is valid
    chat.ChatTemplate()


# --- 2 n-gram join -----------------------------------------------------------------------

def components_by_force(rows, k, num):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def test_ngram_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i == 3 else "" if i == 4 else "two words" if i in (5, 6) else "x") for i in range(8)]
    at = 8
    for family in range(6):  # families whose members lie around the threshold
        base = [f"f{family}w{j}" for j in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
            rows.append((at, " ".join(w[:len(w) - int(rng.integers(0, 3))])))
            at += 1
    rows += [(at + i, rows[20][1]) for i in range(30)]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as n")
    for k, num in ((4, 85), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in ngram_join.component_ids(docs, ngram_join.JoinSpec(words=k, num=num, min_frequent=4)).collect()}
        assert got == components_by_force(rows, k, num)


def test_keep_one_keeps_rows_without_links(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "a b c d e f g"), (9, "q r s t u v"), (9, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] for r in ngram_join.keep_one(docs).collect()), key=lambda x: (x is None, x))
    assert got == [1, 3, 4, 9, None]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


# --- 3 mixing ----------------------------------------------------------------------------

def test_raking_meets_the_marginals(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", None][i % 3], ["en", "de"][i % 7 % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' as topic")
    out = mixing.mix(docs, mixing.MixSpec(rounds=15, rate=0.3)).toPandas()
    out["source"] = out["source"].fillna("")
    natural = out.groupby("source")["n_tokens"].sum() ** 0.7
    got = (out["n_tokens"] * out["probability"]).groupby(out["source"]).sum()
    assert np.allclose(natural / natural.sum(), got / got.sum(), atol=2e-3)
    assert out["probability"].between(0, 1).all() and list(out.columns).count("topic") == 1
    share = out["n_tokens"][out["sampled"]].sum() / out["n_tokens"].sum()
    assert abs(share - 0.3) < 0.05
    assert mixing.mix(docs.limit(0)).count() == 0


def test_link_numbers_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", 4)
    rows = []
    for base in range(3):
        text = [f"b{base}w{i}" for i in range(60)]
        for _ in range(25):
            w = list(text)
            for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
                w[at] = f"x{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(4)] + [(300, None), (301, ""), (302, "alone in the world of words"), (None, rows[3][1]), (7, rows[7][1])]
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j:j + 4]) for j in range(len(w) - 3)}))
    want = [(i, sum(1 for k, (j, y) in enumerate(sets) if k != at and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y)) if i is not None else 0)
            for at, (i, x) in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.component_ids(docs, ngram_join.JoinSpec(words=4, num=85)).select("doc_id", "n_links").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert max(k for _, k in want) > 10


# --- 4 trie ------------------------------------------------------------------------------

def test_elias_fano_access_and_successor():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 7), (1000, 1 << 64), (1000, 1001), (5000, 10**6), (3, 1 << 40)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        ef = EliasFano(encode(v, u))
        if n:
            assert np.array_equal(ef.access(np.arange(n)), v)
        x = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64)])
        place, equal = ef.successor(x)
        want = np.searchsorted(v, x)
        assert np.array_equal(place, want)
        assert np.array_equal(equal, [i < n and v[i] == y for i, y in zip(want, x, strict=True)])


def test_elias_fano_spans_and_ranges():
    rng = np.random.default_rng(2)
    for contexts, ids, fill in ((300, 50, 3), (40, 10_000, 200), (5000, 1 << 30, 1), (2000, 7, 0.02)):
        size = rng.poisson(fill, contexts)
        size[contexts // 2:contexts // 2 + 150] = 0  # many equal pointers in a row
        words_of = [np.sort(rng.choice(min(ids, 20_000), min(k, ids), replace=False)) for k in size]
        keys = np.concatenate([np.uint64(c) * np.uint64(ids) + w.astype(np.uint64) for c, w in enumerate(words_of)])
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words_of])]).astype(np.uint64)
        ef, ptr = EliasFano(encode(keys, contexts * ids)), EliasFano(encode(starts, len(keys) + 1))
        lo, hi = ptr.spans(np.arange(contexts))
        assert np.array_equal(lo, starts[:-1]) and np.array_equal(hi, starts[1:])
        c = rng.integers(0, contexts, 4000)
        x = np.concatenate([keys, c.astype(np.uint64) * np.uint64(ids) + rng.integers(0, min(ids, 20_000), 4000).astype(np.uint64)])
        at = (x // np.uint64(ids)).astype(np.int64)
        want = np.searchsorted(keys, x)
        there = np.array([i < len(keys) and keys[i] == y for i, y in zip(want, x, strict=True)])
        assert np.array_equal(ef.within(x, lo[at], hi[at]), np.where(there, want, -1))


def test_trie_children_by_pointers(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a b d"), (3, None)], "doc_id long, text string")
    trie = lm_trie.train(docs, lm_trie.TrieSpec(order=2, min_count=1))
    col = pa.array(["a b c d"])
    ids = dict(zip("abcd", trie.sequence(col)[0][1:-1].tolist(), strict=True))
    assert sorted(trie.children(1, ids["a"]).tolist()) == sorted([ids["b"], ids["c"]])
    assert sorted(trie.children(1, ids["b"]).tolist()) == sorted([ids["a"], ids["d"]])
    assert sorted(trie.children(1, trie.end + 1).tolist()) == sorted([ids["a"], trie.end])
    assert len(trie.children(1, trie.end)) == 0


@pytest.mark.parametrize("order", [2, 3])
def test_trie_scores_match_dictionaries(spark, order):
    from collections import Counter, defaultdict

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(1000, None), (1001, ""), (1002, "zzz qqq"), (1003, "The of of of"), (1003, "The of of of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    trie = lm_trie.train(docs.where("crc32(string(doc_id)) % 7 <> 2"), lm_trie.TrieSpec(order=order, shard_chars=50_000))
    got = sorted(map(tuple, lm_trie.score(docs, trie).collect()))
    c = [None] + [Counter() for _ in range(order)]
    for t in fit:
        w = ["<s>", *words(t), "</s>"]
        for n in range(1, order + 1):
            c[n].update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    tokens = sum(k for g, k in c[1].items() if g != ("<s>",))
    types = len(c[1]) - 1
    assert (trie.tokens, trie.types) == (tokens, types)
    if order == 3:
        c[3] = Counter({g: k for g, k in c[3].items() if c[2][g[:2]] >= 2})
    total, kept = [None, None] + [Counter() for _ in range(2, order + 1)], [None, None] + [defaultdict(float) for _ in range(2, order + 1)]
    for n in range(2, order + 1):
        for g, k in c[n].items():
            total[n][g[:-1]] += k
        for g, k in c[n].items():
            if k >= 2:
                kept[n][g[:-1]] += (k - 0.75) / total[n][g[:-1]]

    def p(g):
        if len(g) == 1:
            return math.log10((c[1].get(g, 0) + 1) / (tokens + types + 1))
        n, h, low = len(g), g[:-1], p(g[1:])
        if h not in kept[n]:
            return low
        back = 1 - kept[n][h]
        step = lambda x: -round(-math.log10(x) * 256) / 256
        return step((c[n][g] - 0.75) / total[n][h] + back * 10**low) if c[n].get(g, 0) >= 2 else min(step(back), -1 / 256) + low

    want = []
    for i, t in rows:
        w = ["<s>", *words(t), "</s>"]
        want.append((i, len(w) - 1, sum(c[1].get((x,), 0) > 0 for x in w[1:]), sum(p((x,)) for x in w[1:]),
                     sum(p(tuple(w[max(0, k - order + 1):k + 1])) for k in range(1, len(w)))))
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:3] == x[:3] and abs(g[3] - x[3]) < 1e-6
        assert abs(g[4] - x[4]) < 0.01 * math.sqrt(x[1]) + 1e-6  # a code may round the other way


def test_registered_scores_use_all_trigrams_and_those_seen_once(spark):
    from collections import Counter, defaultdict

    from playlens.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["score"] for r in queries.op4_lm_score(spark, SMALL).collect()}
    assert len(got) == len(rows)
    c = [None, Counter(), Counter(), Counter()]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = ["<s>", *words(t), "</s>"]
            for n in (1, 2, 3):
                c[n].update(tuple(w[k:k + n]) for k in range(len(w) - n + 1))
    tokens, types = sum(k for g, k in c[1].items() if g != ("<s>",)), len(c[1]) - 1
    total, kept = defaultdict(int), defaultdict(float)
    for n in (2, 3):
        for g, k in c[n].items():
            total[g[:-1]] += k
        for g, k in c[n].items():
            kept[g[:-1]] += (k - 0.75) / total[g[:-1]]

    def p(g):
        if len(g) == 1:
            return math.log10((c[1].get(g, 0) + 1) / (tokens + types + 1))
        h, low = g[:-1], p(g[1:])
        if h not in kept:
            return low
        back = 1 - kept[h]
        return math.log10((c[len(g)][g] - 0.75) / total[h] + back * 10**low) if g in c[len(g)] else math.log10(back) + low

    for i, t in rows:
        w = ["<s>", *words(t), "</s>"]
        want = sum(p(tuple(w[max(0, k - 2):k + 1])) for k in range(1, len(w)))
        assert abs(got[i] - want) < 0.01 * len(w)  # codes are quantised


def test_trie_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    trie = lm_trie.train(docs.limit(0))
    assert sorted(map(tuple, lm_trie.score(docs, trie).collect())) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]


# --- 5 decontamination -------------------------------------------------------------------

def test_containment_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 40))))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w2 w3")]
    docs = []
    for i in range(60):
        w = list(rng.choice(vocab, int(rng.integers(0, 200))))
        if i % 2:
            q = items[int(rng.integers(0, 25))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                q[int(rng.integers(0, len(q)))] = "zz"
            w[len(w) // 2:len(w) // 2] = q
        docs.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    docs += [(70, None), (71, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    tok = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for i, t in docs:
        w = tok(t)
        for j, s in items:
            x = tok(s)
            k = min(5, len(x))
            grams = {tuple(x[a:a + k]) for a in range(len(x) - k + 1)} if x else set()
            have = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)}
            n = len(grams & have)
            if grams and 100 * n >= 80 * len(grams) and n:
                want.add((i, j, len(grams), n))
    for block in (2_000_000, 150):  # one block of items, and several
        got = {tuple(r[:4]) for r in decontaminate.find(d, q, decontaminate.DecontamSpec(max_shingles=block)).collect()}
        assert got == want
    kept = {r[0] for r in decontaminate.drop(d, q).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want}


# --- 6 toxicity --------------------------------------------------------------------------

def test_levenshtein_automaton_matches_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(5)
    spec = toxicity.ToxSpec()
    terms = ["abc", "abcab", "bcabca", "aabbccaabb", "ccccc"]
    lex = toxicity.Lexicon(dict.fromkeys(terms, 1.0), spec)
    for _ in range(4000):
        w = "".join(rng.choice(list("abc"), int(rng.integers(1, 12))))
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t, spec)]
        got = lex.lookup(w)
        assert (got is None) == (not near) and (not near or got[::-1] == min(near)), w


def test_toxicity_learns_and_separates_quotation(spark):
    rng = np.random.default_rng(6)
    clean = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(500):
        w = list(rng.choice(clean, 40))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(0, 40)), ["scoundrel", "villainous"][int(rng.integers(0, 2))])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "word1 sc0undrel word2 viIlainous word9 scoundrol")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5] + [(901, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.lexicon.weights) == {"scoundrel", "villainous"}
    got = {r[0]: (r[1], r[2]) for r in toxicity.score(docs, model).collect()}
    assert all(got[r[0]][1] == r[2] for r in rows) and got[902][1] == 1
    assert got[900] == got[901] and got[900][1] == 0
    plain, quoted = (model.lexicon.features(t)[1] for t in ("x scoundrel y", 'x said "scoundrel" y'))
    assert quoted < plain
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


# --- 7 HTML ------------------------------------------------------------------------------

@pytest.mark.parametrize("html,text", [
    ("<html><head><title>x</title><style>p{}</style></head><body><h1>A  b</h1><p>one<p>two<br>three<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>tail",
     "A b\n\none\n\ntwo\nthree\n\n- a\n- b\n  1. x\n  2. y\n- c\n\ntail"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><td>a</td><td>b</td></table>", "a  b"),
    ("<table><tr><th colspan=2>head wide</th></tr><tr><td>x</td><td>y</td></tr></table>", "head wide\nx  y"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>yes &amp; &lt;b&gt;</p><script>var t='</p>';</script><!-- c -->ok", "yes & <b>\n\nok"),
    ("<pre>a\n  b\n\nc</pre>x", "a\n  b\n\nc\n\nx"),
    ("a < b and <b>bold</b>text", "a < b and boldtext"), ("", ""), (None, None), ("x<", "x<"), ("x<a href=", "x"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</td></tr></table>", "a        b\n\nin  ner"),
    ("<div>" * 20000 + "deep", "deep"),
])
def test_render(html, text):
    assert html_text.render(html) == text


def test_all_visible_words_survive(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for html, text in html_text.extract(pages.withColumn("text", pages["url"])).select("html", "text").collect():
        body = re.sub(r"(?is)<!--.*?-->|<(head|script|style)\b.*?</\1>", " ", html)
        from html import unescape
        assert unescape(re.sub(r"<[^>]*>", " ", body)).split() == re.sub(r"(?m)^\s*(- |\d+\. )", "", text).split() or "<li" in html


# --- 9 and 10 classifiers ----------------------------------------------------------------

def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "123 ... !!", None)], docs.schema)
    model = langid.train(docs.where("doc_id % 3 <> 1"))
    out = langid.predict(docs.unionByName(odd).withColumn("score", docs["lang"]), model).collect()
    held = [r for r in out if r["doc_id"] % 3 == 1 and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    for r in out:
        if r["doc_id"] > 9000:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert langid.predict(docs, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark, tmp_path):
    spec = quality.QualitySpec(order=3, shards=3)
    texts = spark.createDataFrame([("abracadabra",), ("banana band",), ("",), (None,)], "text string")
    folder = quality.train(texts, spec)
    s = quality.Scorer(folder, spec)
    seen = sorted(set("abracadabrabanana band"))
    for ctx in ("ab", "an", "zz", "d "):
        codes = [quality._grams(quality._codes(ctx + ch, 0), 3)[0] for ch in seen]
        keys = np.sort(np.array(codes, np.uint64))
        unknown = 10 ** s.log10(quality._grams(quality._codes(ctx + "Q", 0), 3), 3)[0]
        assert abs((10 ** s.log10(keys, 3)).sum() + unknown - 1) < 1e-3, ctx


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, None, None), (9003, "\x01#" * 400, "en", "s", 1)], docs.schema)
    out = {r["doc_id"]: r for r in quality.classify(docs.unionByName(odd), labels).collect()}
    assert not any(out[i]["keep"] for i in (9001, 9002, 9003)) and out[9001]["perplexity"] is None
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [out[i]["keep"] for i, q in marked.items() if q == 1 and i in out]
    bad = [out[i]["keep"] for i, q in marked.items() if q == 0 and i in out]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.5 * max(1, len(bad))
    assert quality.classify(docs.limit(3), labels.limit(0)).where("keep").count() == 3


def test_long_trusted_texts_train_the_model(spark):
    docs = spark.createDataFrame([(i, ("a long text of trust " * 1500) + str(i), "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    out = quality.classify(docs, labels, keep_columns=["doc_id"]).collect()
    assert len(out) == 20 and all(r["perplexity"] is not None for r in out)


def test_counts_of_long_texts_by_slices(monkeypatch):
    from collections import Counter

    texts = ["abcabcabcabcx", None, "", "ab", "cabcabcab" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def counts():
        c = Counter()
        for b in quality._count_rows(quality.QualitySpec())([batch]):
            for k, n in zip(b.column("gram").to_pylist(), b.column("c").to_pylist(), strict=True):
                c[k] += n
        return c

    whole = counts()
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert counts() == whole and sum(whole.values()) == sum(len(t or "") for t in texts)


def test_keep_one_decides_each_row_of_a_repeated_id(spark):
    a, b = ([f"{x}{i}" for i in range(50)] for x in "ab")
    near = lambda w, k: " ".join([*w[:-1], f"x{k}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, ""), (3, near(a, 1)), (9, near(b, 2)), (9, None), (9, "a text of its own here"),
            (7, "one and the same text"), (7, "one and the same text"), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.keep_one(docs, ngram_join.JoinSpec(words=4, num=85)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [rows[k] for k in (1, 2, 3, 5, 6, 7, 9)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_order_and_unique_of_the_trie_are_numpys():
    from playlens.llm.lm_trie import _distinct, _order, _unique
    rng = np.random.default_rng(6)
    for x in (rng.integers(0, 50, 300).astype(np.uint64), rng.integers(-1, 9, 40), rng.integers(0, 2 ** 63, 300).astype(np.uint64) * np.uint64(2),
              np.array([2 ** 64 - 1, 0, 2 ** 64 - 1], np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array([5])):
        assert _order(x).tolist() == np.argsort(x, kind="stable").tolist()
        for f in (_unique, _distinct):
            for mine, numpys in zip(f(x), np.unique(x, return_inverse=True), strict=True):
                assert mine.tolist() == numpys.tolist()

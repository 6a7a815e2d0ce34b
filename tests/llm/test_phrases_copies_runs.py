"""Collocations, SimHash near-duplicates and periodic runs against brute force, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from playlens.llm import blocks, periodic, phrases, simhash
from playlens.llm.common import join_hot

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"
CLASHING = ("id", "code", "f", "a", "l", "r", "n", "rank", "score", "word", "fp", "seg", "value", "own", "comp", "runs", "best", "start", "collapsed")


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns})


# --- 11 phrases --------------------------------------------------------------------------

def collocations_by_force(rows, spec):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, spec.max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= spec.min_count}
        gone = {p[i:j] for p, a in cands.items() if len(p) == 3 for i, j in ((0, 2), (1, 3)) if 100 * a >= spec.inside * count[p[i:j]]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(best[:spec.top])]
    return sorted(out)


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("spec", [phrases.PhraseSpec(min_count=3), phrases.PhraseSpec(min_count=2, tile=2, head_words=4, head_all=9, held=50, sparse=2, top=300),
                                  phrases.PhraseSpec(min_count=3, max_words=2, head_words=512)])
def test_collocations_match_brute_force(spark, spec):
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "ab", "é", "É", "x-y", "漢字", " ", "w9", *[f"v{i}" for i in range(30)]]
    seps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "!?", "\x0b", " ; "]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(0, 200)))) for _ in range(60)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " \t\n. "), ("fr", "one"), ("en", "a b " * (blocks.BLOCK // 2) + "." + "v1 v2 v3 " * 3000),  # read in slices
             ("en", "z" * 20000 + " a b a b"), ("en", "z" * 20000 + " a b a b")]
    docs = with_clashes(spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], SCHEMA))
    got = sorted(tuple(r) for r in phrases.collocations(docs, spec).select(*COLS).collect())
    assert got == collocations_by_force(rows, spec)
    assert phrases.collocations(docs.limit(0), spec).count() == 0


def test_products_past_64_bits(spark):
    rows = spark.createDataFrame([(10**15 - 1, 10**15, 10**15), (10**14, 3 * 10**14, 7 * 10**14)], "a long, l long, r long")
    got = [r[0] for r in rows.select(phrases._score("a", "l", "r")).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in ((10**15 - 1, 10**15, 10**15), (10**14, 3 * 10**14, 7 * 10**14))]


# --- 12 SimHash --------------------------------------------------------------------------

def fingerprint_by_force(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(rows, radius=2):
    """Smallest id per id; rows of one id are one."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_fingerprints_of_texts(spark):
    texts = [None, "", " \n", "one", "ONE", "one two", "É é B b\x0bc\x1cd", "a b c d e f " * 3, "x " * 40000 + "y", "  wide"]
    for t in texts:
        assert simhash.fingerprint(t, simhash.SimSpec()) == fingerprint_by_force(t)
    line = "red green blue"
    signed = spark.createDataFrame([(line,)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint(line, simhash.SimSpec()) == signed % 2**64


@pytest.mark.parametrize("most_pairs", [0, 4, 1024])
def test_links_of_planted_fingerprints(spark, most_pairs):
    """Crowds within few bits, chains and lone ones; every limit gives the same classes."""
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for base in (0, rng.getrandbits(64), rng.getrandbits(64) | 1 << 63):
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(120)}
        prints |= {base ^ (1 << b) for b in (0, 1, 31, 32, 62, 63)}
    prints = sorted(prints)
    want = components_by_force(list(enumerate(prints)))
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    from playlens.llm.common import components
    pairs = simhash.links(df, simhash.SimSpec(most_pairs=most_pairs))
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in pairs.collect())
    got = {r["node"] % 2**64: r["comp"] % 2**64 for r in components(pairs).collect()}
    groups = defaultdict(set)
    for i, p in enumerate(prints):
        groups[got.get(p, p)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))


def test_near_duplicates_match_brute_force(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "x"), (-2, "", "x"), (-3, " \n", "x"), (-4, "long text here " * 9000, "x"), (-4, "long text here " * 9000, "x"), (-5, "alpha", "x"),
           (-5, "some other words of one id", "x"), (-6, "alpha", "x"), (None, "alpha", "x"), (-7, "some other words of one id", None)]
    docs = with_clashes(base.unionByName(spark.createDataFrame(odd, SCHEMA)))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = [(i, fingerprint_by_force(t)) for i, t in rows if i is not None]
    root = components_by_force(known)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = sorted((repr(i), f"{fingerprint_by_force(t):016x}", repr(root[i] if i is not None else None)) for i, t in rows)
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got.collect()) == want
    assert root[-1] == root[-3] and root[-5] == root[-7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_join_hot(spark):
    rows = spark.createDataFrame([(1,)] * 3000 + [(2,)] * 3 + [(None,)], "k long")
    labels = spark.createDataFrame([(1, 3000, "x"), (2, 3, "y"), (3, 0, "z")], "k long, n long, v string")
    got = Counter((r["k"], r["v"]) for r in join_hot(rows, labels, "k").collect())
    assert got == {(1, "x"): 3000, (2, "y"): 3, (None, None): 1}


# --- 13 periodic runs --------------------------------------------------------------------

def runs_by_force(ids, spec):
    n, out = len(ids), {}
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i - s + q >= max(spec.min_length, spec.times * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("spec", [periodic.RunSpec(), periodic.RunSpec(2, 2), periodic.RunSpec(3, 1)])
def test_runs_match_brute_force(spec):
    rng = random.Random(1)
    for _ in range(1500):
        ids = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(0, 60))]
        if ids and rng.random() < 0.5:
            a, p = rng.randrange(len(ids)), rng.randrange(1, 8)
            ids = [x if i < a else ids[min(len(ids) - 1, a + (i - a) % p)] for i, x in enumerate(ids)]
        assert periodic.find_runs(ids, spec) == runs_by_force(ids, spec), ids


def test_run_digests(spark):
    spec = periodic.RunSpec()
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, None, "x"), (-2, "", "x"), (-3, " \n", "x"), (None, "a " * 9, "x"), (-4, "a b " * 9 + "c " * 9, "x"), (-4, "a b " * 9 + "c " * 9, "x"),
           (-5, "A a " * 2500 + "x y z", None), (-6, "a a a a a a b b b b b b", "x")]
    docs = with_clashes(base.unionByName(spark.createDataFrame(odd, SCHEMA)))
    got = Counter(tuple(r) for r in periodic.digests(periodic.detect(docs, rewrite=periodic.plant_period)).collect())
    want = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = runs_by_force(w, spec) if len(w) < 6000 else periodic.find_runs(list(map(list(dict.fromkeys(w)).index, w)), spec)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = None
        for s, n, q in runs:
            if best is None or (n * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
                best = (s, n, q)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[(r["doc_id"], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
              sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))] += 1
    assert got == want
    assert periodic.detect(docs.limit(0)).count() == 0


def test_slices_of_arrow_columns():
    """Columns with an offset are read from their own first row."""
    col = pa.array(["x", "a b", None, "c"]).slice(1)
    assert [i for i, *_ in phrases._slices(col)] == [0]

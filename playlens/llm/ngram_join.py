"""N-gram Jaccard join by vertical partitioning.

A text's set is its distinct word n-grams as 64-bit hashes. All texts order
their n-grams alike: frequent ones last (by a counting sketch of fixed size),
then by hash. The order is used twice.

Candidates. With similarity s, two sets can only reach s if they share an n-gram
among the first n - ceil(s n) + 1 of each (prefix). At the first shared n-gram,
at places p and q, the similarity is at most
min(n-p, m-q) / (p + q + max(n-p, m-q)); pairs below s are not made.

N-grams that only one class has in its prefix are counted away first, packed.

Partial overlaps. The order is cut into fragments (ranges of the order). Every
candidate pair counts its overlap in each fragment on its own, from the two
segments of that fragment, and the counts are summed per pair. The segments are
written once into the shared folder; pairs carry pointers to them and not sets.

Large groups. Texts with equal sets are one class from the start, so copies cost
nothing. For the rest, a list of all texts that share a prefix n-gram is not
expanded into pairs. First each member meets one hub, the text with the fewest
rarer n-grams before the shared one (the likeliest original); the links found
give components. Then only pairs whose two sides are still in different
components are made, and these are exactly the candidates that could join two
components. Every link between different texts is therefore either verified or
lies inside a component already found; no list is capped.

Numbers of links. All links of a text lie in its component, so ``component_ids``
compares each component's classes in full, block by block: the overlaps of two
blocks are products of their 0-1 matrices over the n-grams both have. The work
grows with the square of a component's classes, the rows with that of its blocks.

Frequency sketch: 2**24 counters per task, saturated at 255, summed per block;
an n-gram is frequent if its counter exceeds 8 times the mean load (at least
16). The result does not depend on it, only the work does.

Nulls: a null or empty text (or one without words) has an empty set and is
linked with nothing; a null id is linked with nothing and has a null component.
Repeated rows are kept; rows of one id are linked through each of their texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm import blocks as B
from playlens.llm import shared_files as files
from playlens.llm.common import aside, bitmap, components, in_bitmap, join_hot, prepare, stored, tidy
from playlens.llm.packed import ROWS_SQL, Counter, gather

SKETCH_BITS = 24
SKETCH_BLOCK = 1 << 18
#: Up to so many dropped ids (16 MB) are sent to the tasks, so that texts stay in place.
BROADCAST_IDS = 1 << 21
#: Classes of one block of a component (about), and n-grams compared at a time.
TILE_CLASSES = 256
TILE_GRAMS = 1 << 14


@dataclass(frozen=True)
class JoinSpec:
    """``words`` per n-gram; a link needs den * |A & B| >= num * |A | B|."""
    words: int = 5
    num: int = 80
    den: int = 100
    #: The order is cut into 2**fragment_bits fragments.
    fragment_bits: int = 2
    min_frequent: int = 16
    #: Prefix n-grams that one task counts.
    shard_grams: int = 1_000_000


def _meta_rows(spec: JoinSpec):
    """(kind 0) id, set size, class of each text; (kind 1) sketch blocks of the task."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint8)
        seen = False
        for b in batches:
            ids = b.column("id")
            sizes, classes, pieces = [], [], []

            def count():
                at, c = np.unique(np.concatenate(pieces) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counters[at] = np.minimum(counters[at].astype(np.int64) + c, 255)
                pieces.clear()

            held = 0
            for _, s in B.distinct_sets(b.column("text"), spec.words):
                sizes.append(len(s))
                digest = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                classes.append(int.from_bytes(digest, "little", signed=True) if len(s) else None)
                if len(s):
                    pieces.append(s)
                    held += len(s)
                    if held > 1 << 20:
                        count()
                        held = 0
            if pieces:
                count()
            seen = True
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), ids, pa.array(sizes, pa.int64()),
                                              pa.array(classes, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        if seen:
            z = zstandard.ZstdCompressor(level=1)
            used = [i for i in range(len(counters) // SKETCH_BLOCK) if counters[i * SKETCH_BLOCK:(i + 1) * SKETCH_BLOCK].any()]
            for i in used:
                blob = z.compress(counters[i * SKETCH_BLOCK:(i + 1) * SKETCH_BLOCK].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([i], pa.int64()), pa.nulls(1, pa.int64()),
                                                  pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], schema=schema)

    return run


def _frequent(meta: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Bitmap (2 MB) of the sketch counters that count as frequent."""
    total = meta.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    limit = max(spec.min_frequent, 8 * total / (1 << SKETCH_BITS))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one block's counters at a time, however many tasks sent theirs
        acc = np.zeros(SKETCH_BLOCK, np.uint32)
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for x in b.column("blob"):
                acc += np.frombuffer(z.decompress(x.as_py(), max_output_size=SKETCH_BLOCK), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()),
                                          pa.array([np.packbits(acc > limit, bitorder="little").tobytes()], pa.binary())],
                                         names=["block", "bits"])

    rows = (meta.where("kind = 1").select(F.col("id").alias("block"), "blob")
                .groupBy("block").applyInArrow(add, "block long, bits binary").collect())
    out = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK // 8), np.uint8)
    for block, bits in rows:
        out[block] = np.frombuffer(bytes(bits), np.uint8)
    return out.reshape(-1)


def _order_keys(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sorted order keys: top bit for frequent n-grams, then 63 bits of the hash."""
    at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    heavy = (frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return np.sort((heavy.astype(np.uint64) << np.uint64(63)) | (s >> np.uint64(1)))


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix_rows(spec: JoinSpec, frequent):
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            out = []
            for _, s in B.distinct_sets(b.column("text"), spec.words):
                if len(s):
                    n = len(s)
                    p = n - (spec.num * n + spec.den - 1) // spec.den + 1
                    out.append((_class_of(s), n, _order_keys(s, frequent.value)[:p].view(np.int64)))
            if out:
                c, n, g = zip(*out, strict=True)
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, g)]).astype(np.int32), pa.array(np.concatenate(g)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), lists], schema=schema)

    return run


def _write_segments(spec: JoinSpec, frequent, wanted, folder: str):
    """Write the order keys of the wanted classes, a file per batch; rows say where
    (cls, file, first, n). A file of a lost task is only left unused."""
    schema = pa.schema([("cls", pa.int64()), ("file", pa.string()), ("first", pa.int64())])

    def run(batches):
        for b in batches:
            cls, first, keys, at = [], [], [], 0
            for _, s in B.distinct_sets(b.column("text"), spec.words):
                if len(s):
                    c = _class_of(s)
                    if in_bitmap(wanted.value, np.array([c]).view(np.uint64))[0]:
                        cls.append(c)
                        first.append(at)
                        keys.append(_order_keys(s, frequent.value))
                        at += len(s)
            if cls:
                name = uuid.uuid4().hex
                files.save(folder, name, np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([name] * len(cls)), pa.array(first, pa.int64())], schema=schema)

    return run


def _overlap_rows(spec: JoinSpec, folder: str):
    """Partial overlap of each pair in each fragment, from the mapped segments."""
    step = 64 - spec.fragment_bits

    def run(batches):
        opened: dict[str, np.ndarray] = {}

        def keys(name: str, first: int, n: int) -> np.ndarray:
            if name not in opened:
                if len(opened) > 64:
                    opened.clear()
                opened[name] = files.load(folder, name)
            return opened[name][first:first + n]

        for b in batches:
            common = np.zeros(b.num_rows, np.int64)
            cols = [b.column(c).to_pylist() for c in ("af", "a0", "an", "bf", "b0", "bn", "frag")]
            for i, (af, a0, an, bf, b0, bn, frag) in enumerate(zip(*cols, strict=True)):
                part = []
                for k in (keys(af, a0, an), keys(bf, b0, bn)):
                    lo = np.searchsorted(k, np.uint64(frag << step)) if frag else 0
                    hi = np.searchsorted(k, np.uint64((frag + 1) << step)) if (frag + 1) >> spec.fragment_bits == 0 else len(k)
                    part.append(k[lo:hi])
                x, y = part if len(part[0]) <= len(part[1]) else part[::-1]
                if len(x):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common[i] = int((y[at] == x).sum())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "an", "b", "bn")] + [pa.array(common)], names=["a", "an", "b", "bn", "common"])

    return run


def _list_grams(spec: JoinSpec, limits: np.ndarray):
    def run(batches):
        held = Counter(limits)
        for b in batches:
            yield from held.add(b.column("grams").flatten().to_numpy().view(np.uint64))
        yield from held.send()

    return run


def _repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of a shard that several classes have in their prefix."""
    k, c = gather(batches)
    yield pa.RecordBatch.from_arrays([pa.array(k[c > 1].view(np.int64))], names=["gram"])


def _places(wanted):
    """(gram, cls, n, pos) of the prefix n-grams in the bitmap."""
    schema = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        for b in batches:
            lists = b.column("grams")
            flat = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            hit = in_bitmap(wanted.value, flat.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column("cls").take(pa.array(row[hit])),
                                              b.column("n").take(pa.array(row[hit])), pa.array(pos[hit].astype(np.int32))], schema=schema)

    return run


def _fits(spec: JoinSpec, a: str, b: str):
    """The bound of the similarity at the first shared n-gram, from n and pos of both sides."""
    ra, rb = F.expr(f"{a}n - {a}pos"), F.expr(f"{b}n - {b}pos")
    return F.lit(spec.den).cast("long") * F.least(ra, rb) >= spec.num * (F.col(f"{a}pos") + F.col(f"{b}pos") + F.greatest(ra, rb))


def _links(pairs: DataFrame, segments: DataFrame, spec: JoinSpec, folder: str) -> DataFrame:
    """The pairs (a, an, b, bn) that are links, by fragment overlaps summed per pair."""
    frags = F.explode(F.sequence(F.lit(0), F.lit((1 << spec.fragment_bits) - 1)))
    at = {x: segments.select(F.col("cls").alias(x), F.col("file").alias(x + "f"), F.col("first").alias(x + "0")) for x in "ab"}
    # rows with pointers, those of one file next to each other; dealt by both files, as
    # a hub that a third of all texts meet would bring all its pairs to one file's task
    asked = (pairs.join(at["a"], "a").join(at["b"], "b").withColumn("frag", frags)
                  .repartition("af", "bf", "frag").sortWithinPartitions("af", "bf"))
    partial = asked.mapInArrow(tidy(_overlap_rows(spec, folder)), "a long, an long, b long, bn long, common long")
    whole = partial.groupBy("a", "an", "b", "bn").agg(F.sum("common").alias("common"))
    return whole.where(F.col("common") * spec.den >= spec.num * (F.col("an") + F.col("bn") - F.col("common")))


def join_classes(docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members has one row per input row: id, n_shingles, cls
    (the class of its set, null if empty) and comp (the component of that class);
    links are the verified links between different sets (a, b, common) that join
    the components."""
    return _joined(docs, spec or JoinSpec(), id_col, text_col)[:2]


def _joined(docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """members and links of ``join_classes``, the components (cls, comp) of linked
    classes, the index of the segments and their folder."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    meta = stored(texts.mapInArrow(tidy(_meta_rows(spec)), "kind int, id long, n long, cls long, blob binary"), "sets")
    members = meta.where("kind = 0").select("id", "n", "cls")
    frequent = spark.sparkContext.broadcast(_frequent(meta, spec))

    only = texts.select("text")
    prefixes = stored(only.mapInArrow(tidy(_prefix_rows(spec, frequent)), "cls long, n int, grams array<long>")
                          .groupBy("cls").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "prefixes")
    grams = prefixes.agg(F.sum(F.size("grams"))).first()[0] or 0
    shards = max(4, -(-grams // spec.shard_grams))
    # the frequent n-grams, few by nature, all lie in the last shard
    limits = np.array([(s << 63) // shards for s in range(1, shards)], np.uint64)
    repeated = stored(prefixes.select("grams").mapInArrow(tidy(_list_grams(spec, limits)), ROWS_SQL)
                              .groupBy("shard").applyInArrow(_repeated, "gram long"), "repeated")
    wanted = spark.sparkContext.broadcast(bitmap(repeated, "gram"))
    shared = stored(prefixes.mapInArrow(tidy(_places(wanted)), "gram long, cls long, n int, pos int").join(repeated, "gram"), "places")
    hubs = (shared.groupBy("gram").agg(F.min(F.struct("pos", "n", "cls")).alias("hub"))
                  .select("gram", F.col("hub.pos").alias("hpos"), F.col("hub.n").alias("hn"), F.col("hub.cls").alias("h")))
    shared = stored(shared.join(hubs, "gram"), "shared")
    folder = files.new_folder(spark, "segments")
    active = shared.select("cls").distinct()
    there = spark.sparkContext.broadcast(bitmap(active, "cls"))
    # texts with equal sets wrote equal segments: any one of them will do
    segments = stored(only.mapInArrow(tidy(_write_segments(spec, frequent, there, folder)), "cls long, file string, first long")
                          .groupBy("cls").agg(F.min(F.struct("file", "first")).alias("x")).select("cls", "x.file", "x.first"), "segment-index")

    def pair(a: str, an: str, b: str, bn: str):
        small = F.col(a) < F.col(b)
        return [F.when(small, F.col(a)).otherwise(F.col(b)).alias("a"), F.when(small, F.col(an)).otherwise(F.col(bn)).cast("long").alias("an"),
                F.when(small, F.col(b)).otherwise(F.col(a)).alias("b"), F.when(small, F.col(bn)).otherwise(F.col(an)).cast("long").alias("bn")]

    star = (shared.where("h <> cls").withColumnsRenamed({"n": "cn", "pos": "cpos"}).where(_fits(spec, "h", "c"))
                  .select(*pair("h", "hn", "cls", "cn")).distinct())
    links = stored(_links(star, segments, spec, folder), "star-links")
    comp = stored(components(links.select("a", "b")), "star-components")

    placed = (shared.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                    .select("gram", "cls", "n", "pos", "h", F.coalesce("comp", "cls").alias("comp")))
    # Lists that still hold two components; their largest side need not meet itself.
    sides = placed.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = (sides.groupBy("gram").agg(F.count(F.lit(1)).alias("sides"), F.max(F.struct("size", "comp")).alias("m"))
                 .where("sides > 1").select("gram", F.col("m.comp").alias("main")))
    open_lists = stored(placed.join(main, "gram"), "open-lists")
    out = open_lists.where("comp <> main").select("gram", *[F.col(c).alias("x" + c) for c in ("cls", "n", "pos", "comp")], "h")
    all_in = open_lists.select("gram", *[F.col(c).alias("y" + c) for c in ("cls", "n", "pos", "comp")], "main")
    rest = (out.join(all_in, "gram")
               .where((F.col("xcomp") != F.col("ycomp")) & (F.col("xcls") != F.col("h")) & (F.col("ycls") != F.col("h"))
                      & ((F.col("ycomp") == F.col("main")) | (F.col("xcls") < F.col("ycls"))) & _fits(spec, "x", "y"))
               .select(*pair("xcls", "xn", "ycls", "yn")).distinct())
    more = stored(_links(rest, segments, spec, folder), "more-links")
    links = links.unionByName(more)
    if more.take(1):
        comp = stored(components(links.select("a", "b")), "components")
    label = comp.withColumnRenamed("node", "cls")
    members = (members.join(label, "cls", "left")
                      .select("id", F.col("n").alias("n_shingles"), "cls", F.coalesce("comp", "cls").alias("comp")))
    return members, links, label, segments, folder


def _tile_links(spec: JoinSpec, folder: str):
    """Per tile (two blocks of classes of one component) and class the rows of the
    classes it is linked with: overlaps of all pairs as products of 0-1 matrices."""
    schema = pa.schema([("cls", pa.int64()), ("n_links", pa.int64())])

    def side(rows: list[dict], opened: dict[str, np.ndarray]):
        got = []
        for r in rows:
            if r["file"] not in opened:
                if len(opened) > 64:
                    opened.clear()
                opened[r["file"]] = files.load(folder, r["file"])
            got.append(np.asarray(opened[r["file"]][r["first"]:r["first"] + r["n"]]))
        # keys with the place of their class, in the order of the keys
        k, at = np.concatenate(got), np.repeat(np.arange(len(rows)), [len(g) for g in got])
        order = np.argsort(k, kind="stable")
        return k[order], at[order], np.array([r["n"] for r in rows], np.int64), np.array([r["docs"] for r in rows], np.int64)

    def shared_only(k: np.ndarray, at: np.ndarray, both: np.ndarray):
        place = np.minimum(np.searchsorted(both, k), len(both) - 1)
        hit = both[place] == k
        return place[hit], at[hit]

    def run(batches):
        opened: dict[str, np.ndarray] = {}
        for b in batches:
            cls, n_links = [], []
            for lo, hi, x, y in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "x", "y")), strict=True):
                kx, ax, nx, dx = side(x, opened)
                ky, ay, ny, dy = (kx, ax, nx, dx) if lo == hi else side(y, opened)
                common = np.zeros((len(x), len(nx) if lo == hi else len(y)), np.float64)
                both = np.intersect1d(kx, ky)
                if len(both):
                    (px, ax), (py, ay) = shared_only(kx, ax, both), shared_only(ky, ay, both)
                    for start in range(0, len(both), TILE_GRAMS):
                        width = min(TILE_GRAMS, len(both) - start)
                        m = []
                        for p, a, size in ((px, ax, len(nx)), (py, ay, len(ny))):
                            i, j = np.searchsorted(p, [start, start + width])
                            one = np.zeros((size, width), np.float32)  # sums up to 2**14 are exact
                            one[a[i:j], p[i:j] - start] = 1
                            m.append(one)
                        common += m[0] @ m[1].T
                common = np.rint(common).astype(np.int64)
                link = common * spec.den >= spec.num * (nx[:, None] + ny[None, :] - common)
                if lo == hi:
                    np.fill_diagonal(link, False)
                cls += [r["cls"] for r in x]
                n_links += (link @ dy).tolist()
                if lo != hi:
                    cls += [r["cls"] for r in y]
                    n_links += (dx @ link).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n_links, pa.int64())], schema=schema)

    return run


def _link_counts(members: DataFrame, comp: DataFrame, segments: DataFrame, spec: JoinSpec, folder: str) -> DataFrame:
    """(cls, n_links): the other rows with an id that a row of the class is linked
    with. Links never leave a component, so each component's classes are dealt to
    blocks and every two blocks are compared in full in one bounded tile."""
    sizes = members.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.count("id").alias("docs"))
    blocks = comp.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / TILE_CLASSES).cast("int").alias("blocks"))
    entry = F.struct("cls", "n", "docs", "file", "first")
    dealt = (comp.join(sizes, "cls").join(segments, "cls").join(blocks, "comp")
                 .withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
                 .groupBy("comp", "blocks", "block").agg(F.collect_list(entry).alias("rows")))
    dealt = stored(dealt, "link-blocks")
    left = dealt.select("comp", F.col("block").alias("lo"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("hi"), F.col("rows").alias("x"))
    right = dealt.select("comp", F.explode(F.expr("sequence(0, block)")).alias("lo"), F.col("block").alias("hi"), F.col("rows").alias("y"))
    tiles = left.join(right, ["comp", "lo", "hi"]).select("lo", "hi", "x", "y")
    other = tiles.mapInArrow(tidy(_tile_links(spec, folder)), "cls long, n_links long").groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    return sizes.join(other, "cls", "left").select("cls", (F.col("docs") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))


def component_ids(docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) per row of ``docs``; component_id
    is the smallest id reachable by links, itself included. n_links counts the
    other rows with an id that the row's own text is linked with, exact copies
    included; rows with an empty set or a null id have 0."""
    spec = spec or JoinSpec()
    members, _, comp, segments, folder = _joined(docs, spec, id_col, text_col)
    degree = _link_counts(members, comp, segments, spec, folder)
    return (_with_component(members).join(degree, "cls", "left")
                .select(F.col("id").alias(id_col), "n_shingles", "component_id",
                        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")))


def _with_component(members: DataFrame) -> DataFrame:
    """``members`` with component_id."""
    smallest = members.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # An id can stand on several rows (with several texts): its rows are linked through it.
    several = members.where("id is not null and comp is not null").groupBy("id").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    if several.take(1):
        rows = members.where("id is not null and comp is not null").select("id", "comp").distinct()
        hub = rows.groupBy("id").agg(F.min("comp").alias("a")).join(rows, "id").where("a <> comp")
        joined = stored(components(hub.select("a", F.col("comp").alias("b"))), "id-components").withColumnsRenamed({"node": "comp", "comp": "root"})
        up = smallest.join(joined, "comp", "left").withColumn("root", F.coalesce("root", "comp"))
        low = up.groupBy("root").agg(F.min("component_id").alias("component_id"))
        smallest = up.select("comp", "root", "n").join(low, "root").select("comp", "component_id", "n")
    # a component on very many rows is not gathered in one task
    return (join_hot(members, stored(smallest, "component-labels"), "comp")
                   .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))))


def _row_classes(spec: JoinSpec):
    """The rows with the class of their text in place of ``__cls`` (null for an empty set)."""
    def run(batches):
        for b in batches:
            text, rest = b.column("__text"), b.drop_columns(["__text", "__cls"])
            cls = [_class_of(s) if len(s) else None for _, s in B.distinct_sets(text, spec.words)]
            yield rest.append_column("__cls", pa.array(cls, pa.int64()))

    return run


def keep_one(docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest
    id. Rows with an empty set or a null id stay. An id on several rows is decided row
    by row, each by its own text; of its rows in one group the first by text stays."""
    prepare(docs.sparkSession)
    spec = spec or JoinSpec()
    docs, back = aside(docs, [id_col, text_col])
    members = stored(join_classes(docs, spec, id_col, text_col)[0].where("id is not null").select(F.col("id").alias(id_col), "cls", "comp"), "members")
    first = members.where("comp is not null").groupBy("comp").agg(F.min(id_col).alias("__first"))
    gone = stored(members.join(first, "comp").where(F.col(id_col) > F.col("__first")).select(id_col).distinct(), "dropped-ids")
    if gone.count() <= BROADCAST_IDS:  # beyond that a shuffle join does the same
        gone = F.broadcast(gone)
    kept = docs.join(gone, id_col, "left_anti")
    several = stored(members.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select(id_col), "repeated-ids")
    if not several.take(1):
        return kept.select(*back)
    own = docs.join(several, id_col, "left_semi").withColumn("__cls", F.lit(None).cast("long"))
    classed = own.withColumn("__text", F.col(text_col).cast("string")).mapInArrow(tidy(_row_classes(spec)), own.schema)
    groups = members.where("comp is not null").select(F.col("cls").alias("__cls"), "comp").distinct().join(first, "comp")
    placed = classed.join(groups.withColumnRenamed("comp", "__comp"), "__cls", "left")
    order = Window.partitionBy(id_col, "__comp").orderBy(text_col, F.to_json(F.struct("rest")))
    once = (placed.where("__cls is not null").where(F.col("__first") == F.col(id_col))
                  .withColumn("__r", F.row_number().over(order)).where("__r = 1"))
    return (kept.join(several, id_col, "left_anti").select(*back)
                .unionByName(placed.where("__cls is null").select(*back)).unionByName(once.select(*back)))

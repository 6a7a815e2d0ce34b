"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits: bit b is set if more than half of the hashes of
its word shingles (repeats included) have it set. Texts whose fingerprints differ in
at most ``radius`` = 2 bits are linked, and links are followed.

Index. A fingerprint is cut in two segments of 32 bits, and each segment has a table
from its value to the fingerprints that have it. Of two fingerprints that differ in
at most two bits, the first segments differ in at most one bit, or else the second
ones are equal. So every fingerprint asks the first table for the Hamming ball of
radius 1 around its segment and the second one for its own value; the distance of
what is found is counted in full. A ball is asked in one direction only (a clear bit
set), so each pair is met once.

Crowded segments. Near copies share segments, and a table entry with many members
that many ask for would give all pairs of them. Where members x askers exceed
``most_pairs``, no pairs are made: the fingerprints concerned put every value of
their balls of radius 1, over both segments, into one table. Two fingerprints differ
in at most two bits exactly if their balls meet, so everyone in an entry is linked
with its smallest member: 65 rows a fingerprint whatever the crowd, and nothing lost.

Copies are one fingerprint from the start. What a copy group of any size costs is a
count per task. Labels of fingerprints on very many rows are sent to the tasks (at
most ``HOT_KEYS`` of them), so that no task gathers such a group.

Nulls: a null or empty text, or one without a word, has fingerprint zero and is
linked like any other. A row without id has a fingerprint, is linked with nothing and
has a null component. Repeated rows are kept; rows of one id are linked through it.
An empty table gives no row. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import components, join_hot, prepare, stored, tidy

#: Hashes whose bits are counted at a time.
VOTES = 1 << 14


@dataclass(frozen=True)
class SimSpec:
    words: int = 3
    seed: int = 42
    #: Pairs made at most of one table entry; beyond that the balls are used.
    most_pairs: int = 1024


def fingerprint(text: str | None, spec: SimSpec) -> int:
    """The fingerprint of one text; ASCII letters count in lower case, words are
    separated by space and 0x09 to 0x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(spec.words, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    votes, digest, seed = np.zeros(64, np.int64), xxhash.xxh64_intdigest, spec.seed
    for at in range(0, len(first), VOTES):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at:at + VOTES], last[at:at + VOTES], strict=True)], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(first)).tobytes(), "big")


def _prints(spec: SimSpec):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), spec) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, spec: SimSpec) -> DataFrame:
    """Verified links (a, b) between the distinct fingerprints ``fp`` of ``prints``,
    through which all that are linked can be reached."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    # own segments, and the first one with one more bit set
    ball = F.expr("filter(transform(sequence(0, 31), j -> shiftleft(1L, j)), x -> (shiftrightunsigned(fp, 32) & x) = 0)")
    asked = F.concat(F.array(F.struct(F.lit(0).alias("seg"), high.alias("value"), F.lit(True).alias("own")),
                             F.struct(F.lit(1).alias("seg"), low.alias("value"), F.lit(True).alias("own"))),
                     F.transform(ball, lambda x: F.struct(F.lit(0).alias("seg"), high.bitwiseOR(x).alias("value"), F.lit(False).alias("own"))))
    probes = prints.select("fp", F.explode(asked).alias("x")).select("fp", "x.seg", "x.value", "x.own")
    members, askers = F.sum(F.col("own").cast("long")), F.count(F.lit(1))
    live = (probes.groupBy("seg", "value").agg(members.alias("members"), askers.alias("askers"))
                  .where("members > 0 and askers > 1")
                  .withColumn("crowded", F.col("members") * F.col("askers") > spec.most_pairs))
    hits = stored(probes.join(live.select("seg", "value", "crowded"), ["seg", "value"]), "probes")
    few = hits.where("not crowded")
    table = few.where("own").select("seg", "value", F.col("fp").alias("b"))
    pairs = (few.select("seg", "value", F.col("fp").alias("a"), "own").join(table, ["seg", "value"])
                .where("not own or a < b").where(_distance("a", "b") <= 2).select("a", "b"))
    crowd = hits.where("crowded").select("fp").distinct()
    around = F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j))"))
    balls = crowd.select("fp", F.explode(around).alias("point"))
    hubs = balls.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub < other").select("point", "hub")
    met = balls.join(hubs, "point").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(met.where(_distance("a", "b") <= 2)).distinct()


def near_duplicates(docs: DataFrame, spec: SimSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) per row: the fingerprint as 16 hexadecimal
    digits and the smallest id that links reach, the row's own included."""
    spec = spec or SimSpec()
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(texts.mapInArrow(tidy(_prints(spec)), "id long, fp long"), "fingerprints")
    known = rows.where("id is not null")
    prints = stored(known.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = links(prints.select("fp"), spec)
    # an id can stand on several rows with several texts: they are linked through it
    several = known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("id", "a")
    own = known.join(several, "id").where("fp <> a").select("a", F.col("fp").alias("b"))
    comp = stored(components(stored(found.unionByName(own), "links")), "components")
    placed = prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    smallest = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    labels = stored(placed.join(smallest, "comp").select("fp", "n", "component_id"), "labels")
    out = join_hot(rows, labels, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))

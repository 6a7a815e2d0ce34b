"""Helpers the operators share: session settings, written tables, bitmaps,
connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlens.session import ensure_checkpoint_dir, scratch_path

#: Arrow batches hand a Python worker at most this much text at a time.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package shipped, Arrow batches bounded in bytes."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut and later jobs do not recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; once a task has read its last batch, the memory that
    its worker has freed goes back to the system. Workers are used again by later
    stages, so what one stage needed for a moment would otherwise be kept by all."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return work


def release() -> None:
    """Give freed memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns ``used`` as they are and all others within one struct,
    ``rest``, where no name can clash; and the expressions that bring back the
    columns of ``docs`` in their order."""
    own = [c for c in docs.columns if c in used]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    back = [F.col(f"`{c}`") if c in used else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return docs.select(*own, rest.alias("rest")), back


def bucket_of(train: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    c = F.col(train) if isinstance(train, str) else train
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(modulus)


BITMAP_BITS = 1 << 24


def bitmap(df: DataFrame, hash_col: str, size: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of ``size`` bits, a power of two (2 MB whatever the input) with the bit of
    every value of a long hash column set. Used only as a pre-filter: a set bit
    may be a chance hit, a clear bit never is."""
    pos = F.pmod(F.col(hash_col), F.lit(size)) + 1  # bucket numbers count from position 1
    rows = (df.select(pos.alias("p"))
              .groupBy(F.bitmap_bucket_number("p").alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect())
    out = np.zeros((size // 32768, 4096), np.uint8)
    for b, m in rows:
        out[b - 1] = np.frombuffer(bytes(m), np.uint8)
    return out.reshape(-1)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned 64-bit hash is set."""
    pos = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a, b long): (node, comp) for every node
    that has an edge, ``comp`` the smallest node reachable.

    Alternating large-star and small-star steps; every step is a partially
    aggregated minimum per node and a join, so a node with very many edges is
    never gathered, and the driver sees only a count and a checksum.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct().checkpoint(eager=True)

    def sign(d: DataFrame):
        return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = sign(e)
    while before["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                      .select("x.u", "x.v").where("u <> v").distinct())
        e = small.checkpoint(eager=True)
        after = sign(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def first_rows(rows: DataFrame, group: str, order: list[Column], most: int, rank: str, spread: int = 8) -> DataFrame:
    """The first ``most`` rows of each ``group`` in ``order``, numbered from 1 in
    ``rank``. Rows are ranked in ``spread`` parts of a group first, so the task that
    numbers a group sees ``spread * most`` rows, however large the group and however
    many tasks it comes from."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    near = (rows.withColumn(rank, part)
                .withColumn(rank, F.row_number().over(Window.partitionBy(group, rank).orderBy(*order))).where(F.col(rank) <= most))
    return (near.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
                .where(F.col(rank) <= most).withColumn(rank, F.col(rank).cast("long")))


#: Keys on very many rows: at most so many, so their labels can be sent to the tasks.
HOT_KEYS = 4096


def join_hot(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with one row of ``labels`` per ``key``; ``labels`` says in
    ``n`` on how many rows a key stands. Keys on more than 1 / ``HOT_KEYS`` of all rows,
    fewer than ``HOT_KEYS`` by count, are joined where the rows are; the others by
    a shuffle. Both sides should be written tables."""
    total = labels.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > max(1000, total // HOT_KEYS)
    hot = F.broadcast(labels.where(many).drop("n"))
    cold = rows.join(F.broadcast(labels.where(many).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(labels.where(~many).drop("n"), key, "left"))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)

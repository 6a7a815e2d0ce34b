"""Stand-in inputs derived from the TPC-H-like test tables.

There is no listening data in the test tables, so each input of the library is
derived from them (see FIXTURES.md):

    plays          orders x lineitem on the order key, summed per (customer, part)
    user_stats     plays per user: total, occurrence, mean
    item_stats     plays per item: the same
    plays_subsets  plays tagged with the user's market segment as ``subset``
    catalogue      part: one row per song (metadata + analysis fields)
    ragged arrays  embeddings: flat values plus one start offset per song
    artist terms   words of documents.text: per-document term statistics
    similar artists conversations: one entry per turn
    artist mbtags  labels (quality = 1) x documents: tag and count

Every derivation reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAGGED_WIDTH = 64   # floats per embedding row in the test tables
RAGGED_ROW = 8      # values per row of the 2-D stand-in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plays(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """(user_id BIGINT, item_id BIGINT, play_count INT), one row per pair. ``ordered``: dealt
    to tasks by ranges of (user, item) and in that order in each; a hot user has several."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity")
    if ordered:  # a range of pairs holds all rows of a pair: the sums need no other exchange
        rows = rows.repartitionByRange("user_id", "item_id")
    sums = rows.groupBy("user_id", "item_id").agg(F.sum("l_quantity").cast("int").alias("play_count"))
    return sums.sortWithinPartitions("user_id", "item_id") if ordered else sums


def plays_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plays + ``subset`` (the user's market segment)."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"),
                                                    F.col("c_mktsegment").alias("subset"))
    return plays(spark, sf_dir).join(cust, "user_id")


def id_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def id_list_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def catalogue_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("song_idx"),
        F.concat(F.lit("SO"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("song_id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist_name"),
        F.col("p_type").alias("release"))


def catalogue_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("song_idx"),
        F.concat(F.lit("TR"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("track_id"),
        F.col("p_retailprice").alias("duration"), F.col("p_size").alias("key"))


def catalogue_musicbrainz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("song_idx"),
        (F.lit(1990) + F.col("p_size")).cast("int").alias("year"))


def ragged_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos BIGINT, value FLOAT): all embedding values laid end to end."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return emb.select(F.posexplode("embedding").alias("i", "value"), "vec_id").select(
        (F.col("vec_id") * RAGGED_WIDTH + F.col("i")).alias("pos"), "value")


def ragged_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_idx BIGINT, idx BIGINT): start offset of each song's values."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    return emb.select(F.col("vec_id").alias("song_idx"), (F.col("vec_id") * RAGGED_WIDTH).alias("idx"))


def ragged_flat_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos BIGINT, value ARRAY<FLOAT>): the flat values cut into rows of 8."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows_per = RAGGED_WIDTH // RAGGED_ROW
    return emb.select("vec_id", F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(rows_per - 1)),
                    lambda r: F.slice("embedding", r * RAGGED_ROW + 1, RAGGED_ROW))).alias("r", "value")
    ).select((F.col("vec_id") * rows_per + F.col("r")).alias("pos"), "value")


def ragged_songs_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_per = RAGGED_WIDTH // RAGGED_ROW
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    return emb.select(F.col("vec_id").alias("song_idx"), (F.col("vec_id") * rows_per).alias("idx"))


#: Stored bytes of documents whose words one task counts, ranks and gathers at a time.
TERM_BYTES = 4 << 20


def _tasks_for(rows: DataFrame, each: int) -> int:
    """Tasks of ``each`` stored bytes for a whole table, by the size of its files (no scan); no
    fewer than the session's shuffle partitions, so that a join after it deals nothing anew."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / each)) if size < 1 << 60 else least  # no size known


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, pos, term, freq, weight) from whole documents.

    term = lower-cased word (split on non-word characters), freq = count / words
    in the document, weight = count / largest count in the document,
    pos = 0-based rank by (count desc, term).
    """
    # texts are dealt by document once; counts and ranks then need no other exchange. A task
    # holds a row for each of its words, so tasks follow the size of the table, unmerged
    whole = table(spark, sf_dir, "documents")
    docs = whole.select("doc_id", "text").repartition(_tasks_for(whole, TERM_BYTES), "doc_id")
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"\W+")).alias("term")) \
                .filter(F.col("term") != "")
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
    per_doc = Window.partitionBy("doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.col("cnt").desc(), F.col("term"))
    return counts.select(
        F.col("doc_id").alias("track_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        "term",
        (F.col("cnt") / F.sum("cnt").over(per_doc)).alias("freq"),
        (F.col("cnt") / F.max("cnt").over(per_doc)).alias("weight"))


def similar_artist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, pos, artist): one entry per conversation turn."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("track_id"), F.col("turn").alias("pos"),
                       F.col("role").alias("artist"))


def artist_mbtag_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tags (track_id, pos, tag) and counts (track_id, pos, count).

    A labelled document with quality = 1 has one tag (its source) whose count
    is its toxic flag; every other document has no tags and no counts.
    """
    labels = table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    tagged = labels.join(docs, "doc_id")
    tags = tagged.select(F.col("doc_id").alias("track_id"), F.lit(0).cast("bigint").alias("pos"),
                         F.col("source").alias("tag"))
    counts = tagged.select(F.col("doc_id").alias("track_id"), F.lit(0).cast("bigint").alias("pos"),
                           F.col("toxic").alias("count"))
    return tags, counts


#: The catalogue's scalar fields, each an expression over ``part`` (Spark and ANSI SQL
#: alike); nulls where a song has no place or no known length.
SCALARS = {
    "artist_familiarity": "CAST(p_size AS DOUBLE) / 50", "artist_hotttnesss": "CAST(p_partkey % 97 AS DOUBLE) / 97",
    "artist_id": "concat('AR', p_brand)", "artist_mbid": "md5(p_brand)", "artist_playmeid": "CAST(p_size * 10 AS INT)",
    "artist_7digitalid": "CAST(p_partkey % 1000 AS INT)",
    "artist_latitude": "CASE WHEN p_size % 7 <> 0 THEN CAST(p_partkey % 181 - 90 AS DOUBLE) END",
    "artist_longitude": "CASE WHEN p_size % 7 <> 0 THEN CAST(p_partkey % 361 - 180 AS DOUBLE) END",
    "artist_location": "CASE WHEN p_size % 7 <> 0 THEN p_type END", "artist_name": "p_brand", "release": "p_type",
    "release_7digitalid": "CAST(p_partkey % 5000 AS INT)", "song_id": "concat('SO', lpad(CAST(p_partkey AS STRING), 10, '0'))",
    "song_hotttnesss": "CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 3000 END", "title": "p_name",
    "track_7digitalid": "CAST(p_partkey * 3 AS INT)",
    "analysis_sample_rate": "CAST(CASE WHEN p_size % 2 = 0 THEN 22050 ELSE 44100 END AS INT)", "audio_md5": "md5(p_name)",
    "danceability": "CAST(p_size % 10 AS DOUBLE) / 10", "duration": "p_retailprice", "end_of_fade_in": "CAST(p_size AS DOUBLE) / 8",
    "energy": "CAST(p_partkey % 11 AS DOUBLE) / 11", "key": "p_size", "key_confidence": "CAST(p_partkey % 101 AS DOUBLE) / 101",
    "loudness": "CAST(p_size AS DOUBLE) - 60", "mode": "CAST(p_partkey % 2 AS INT)",
    "mode_confidence": "CAST(p_partkey % 103 AS DOUBLE) / 103", "start_of_fade_out": "p_retailprice - p_size",
    "tempo": "CAST(60 + p_partkey % 120 AS DOUBLE)", "time_signature": "CAST(3 + p_size % 3 AS INT)",
    "time_signature_confidence": "CAST(p_partkey % 107 AS DOUBLE) / 107",
    "track_id": "concat('TR', lpad(CAST(p_partkey AS STRING), 10, '0'))", "year": "CAST(1990 + p_size AS INT)",
}

#: The catalogue's offset columns: a song (``embeddings`` row) v has (v * m) % 7 values.
OFFSETS = {
    "idx_similar_artists": 1, "idx_artist_terms": 2, "idx_segments_start": 3, "idx_segments_confidence": 4,
    "idx_segments_pitches": 5, "idx_segments_timbre": 6, "idx_segments_loudness_max": 1, "idx_segments_loudness_max_time": 2,
    "idx_segments_loudness_start": 3, "idx_sections_start": 4, "idx_sections_confidence": 5, "idx_beats_start": 6,
    "idx_beats_confidence": 1, "idx_bars_start": 2, "idx_bars_confidence": 3, "idx_tatums_start": 4, "idx_tatums_confidence": 5,
    "idx_artist_mbtags": 6,
}
#: Arrays of text, and arrays of rows of four numbers; the others hold numbers.
TEXT_ARRAYS = ("similar_artists", "artist_terms", "artist_mbtags")
ROW_ARRAYS = ("segments_pitches", "segments_timbre")


def first_value(m: int) -> str:
    """Where the values of song vec_id begin if song v has (v * m) % 7 (any seven songs
    in a row have 0 to 6 in some order, 21 together)."""
    steps = " ".join(f"WHEN {r} THEN {sum(j * m % 7 for j in range(r))}" for r in range(7))
    return f"(21 * ((vec_id - vec_id % 7) / 7) + CASE vec_id % 7 {steps} END)"


def catalogue_groups(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three groups of the catalogue with all scalar fields, a row per ``part``."""
    from playlens.operators.catalogue import FIELDS
    part = table(spark, sf_dir, "part")
    return {g: part.select(F.col("p_partkey").cast("int").alias("song_idx"),
                           *[F.expr(e).alias(n) for n, e in SCALARS.items() if FIELDS[n].group == g])
            for g in ("metadata", "analysis", "musicbrainz")}


def catalogue_offsets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The offset columns of each group, a row per ``embeddings`` row."""
    from playlens.operators.catalogue import FIELDS
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    return {g: emb.select(F.col("vec_id").alias("song_idx"),
                          *[F.expr(first_value(OFFSETS[o])).cast("long").alias(o)
                            for o in dict.fromkeys(f.offset for f in FIELDS.values() if f.offset and f.group == g)])
            for g in ("metadata", "analysis", "musicbrainz")}


def catalogue_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, pos, num, txt, row): the values of every array field end to end. Value i of
    song v is the number i + 1 + k of its embedding (k: the field's place), in arrays of
    rows the i-th four of them, in arrays of text a word made of v and i."""
    from playlens.operators.catalogue import RAGGED_FIELDS
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = None
    for k, (name, offset) in enumerate(RAGGED_FIELDS.items()):
        m = OFFSETS[offset]
        rows = emb.select("vec_id", "embedding", F.expr(f"explode(slice(sequence(0, 6), 1, cast(vec_id * {m} % 7 as int)))").alias("i"))
        num = F.lit(None).cast("double") if name in (*TEXT_ARRAYS, *ROW_ARRAYS) else F.expr(f"cast(embedding[i + {k}] as double)")
        txt = F.expr(f"concat('{name[:3]}', cast((vec_id + i) % 13 as string))") if name in TEXT_ARRAYS else F.lit(None).cast("string")
        four = (F.expr("transform(slice(embedding, i * 4 + 1, 4), x -> cast(x as double))") if name in ROW_ARRAYS
                else F.lit(None).cast("array<double>"))
        part = rows.select(F.lit(name).alias("field"), (F.expr(first_value(m)).cast("long") + F.col("i")).alias("pos"),
                           num.alias("num"), txt.alias("txt"), four.alias("row"))
        out = part if out is None else out.unionByName(part)
    return out

"""Song catalogue: scalar fields, ragged per-song arrays, term and tag tables.

The catalogue is a set of decoded tables (decoding the binary container format
is not part of this library): one row per song in each of the metadata,
analysis and musicbrainz groups, matched by ``song_idx``; ragged arrays as a
flat table (pos, value) plus one start offset per song. Every getter works on
all songs at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.numbering import global_index

# Scalar fields of the catalogue groups, by group (fixed names).
METADATA_FIELDS = ("artist_familiarity", "artist_hotttnesss", "artist_id", "artist_mbid",
                   "artist_playmeid", "artist_7digitalid", "artist_latitude", "artist_longitude",
                   "artist_location", "artist_name", "release", "release_7digitalid", "song_id",
                   "song_hotttnesss", "title", "track_7digitalid")
ANALYSIS_FIELDS = ("analysis_sample_rate", "audio_md5", "danceability", "duration", "end_of_fade_in",
                   "energy", "key", "key_confidence", "loudness", "mode", "mode_confidence",
                   "start_of_fade_out", "tempo", "time_signature", "time_signature_confidence", "track_id")
MUSICBRAINZ_FIELDS = ("year",)
# Ragged arrays and the offset column each one uses.
RAGGED_FIELDS = {
    "similar_artists": "idx_similar_artists", "artist_terms": "idx_artist_terms",
    "artist_terms_freq": "idx_artist_terms", "artist_terms_weight": "idx_artist_terms",
    "segments_start": "idx_segments_start", "segments_confidence": "idx_segments_confidence",
    "segments_pitches": "idx_segments_pitches", "segments_timbre": "idx_segments_timbre",
    "segments_loudness_max": "idx_segments_loudness_max",
    "segments_loudness_max_time": "idx_segments_loudness_max_time",
    "segments_loudness_start": "idx_segments_loudness_start", "sections_start": "idx_sections_start",
    "sections_confidence": "idx_sections_confidence", "beats_start": "idx_beats_start",
    "beats_confidence": "idx_beats_confidence", "bars_start": "idx_bars_start",
    "bars_confidence": "idx_bars_confidence", "tatums_start": "idx_tatums_start",
    "tatums_confidence": "idx_tatums_confidence", "artist_mbtags": "idx_artist_mbtags",
    "artist_mbtags_count": "idx_artist_mbtags",
}


@dataclass(frozen=True)
class Field:
    """Where a field is read: its group, and for an array the column with the offset
    of a song's first value (tags: that of the musicbrainz group throughout)."""
    group: str
    offset: str | None = None


def _array_group(name: str) -> str:
    if name.startswith("artist_mbtags"):
        return "musicbrainz"
    return "metadata" if name.startswith(("artist_", "similar_")) else "analysis"


#: Every getter's field by name.
FIELDS = {
    **{n: Field("metadata") for n in METADATA_FIELDS}, **{n: Field("analysis") for n in ANALYSIS_FIELDS},
    **{n: Field("musicbrainz") for n in MUSICBRAINZ_FIELDS},
    **{n: Field(_array_group(n), offset) for n, offset in RAGGED_FIELDS.items()},
}


def _known(names: Sequence[str], array: bool) -> None:
    wrong = [n for n in names if n not in FIELDS or (FIELDS[n].offset is not None) != array]
    if wrong:
        raise ValueError(f"not {'arrays' if array else 'scalar fields'} of the catalogue: {wrong}")


def scalar_fields(groups: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """(song_idx, names...) for all songs, out of the group tables (metadata, analysis,
    musicbrainz; one row per song_idx). Only the groups and columns that the names
    need are read and joined."""
    _known(names, False)
    out = None
    for group in dict.fromkeys(FIELDS[n].group for n in names):
        part = groups[group].select("song_idx", *[n for n in dict.fromkeys(names) if FIELDS[n].group == group])
        out = part if out is None else out.join(part, "song_idx")
    return out.select("song_idx", *names)


def array_fields(groups: Mapping[str, DataFrame], flat: DataFrame, names: Sequence[str]) -> DataFrame:
    """(field, song_idx, i, values...): each song's slice of each named array, i from 0.

    ``groups`` hold the offset columns, ``flat`` (field, pos, values...) the arrays of
    all fields end to end, best stored by field. Every array is cut by its own offset
    column; all fields are cut in one pass, and only theirs are read."""
    _known(names, True)
    starts = None
    for group in dict.fromkeys(FIELDS[n].group for n in names):
        own = [F.struct(F.lit(n).alias("field"), F.col(FIELDS[n].offset).cast("long").alias("pos"))
               for n in dict.fromkeys(names) if FIELDS[n].group == group]
        part = groups[group].select("song_idx", F.explode(F.array(*own)).alias("x")).select("x.field", "x.pos", "song_idx")
        starts = part if starts is None else starts.unionByName(part)
    found = owner_of(starts, flat.filter(F.col("field").isin(*names)), ["field"])
    return found.select("field", "song_idx", (F.col("pos") - F.col("start")).alias("i"),
                        *[c for c in flat.columns if c not in ("field", "pos")])


#: Positions of one block of ``owner_of``: what a window task orders at most.
SPAN = 1 << 16


def owner_of(starts: DataFrame, values: DataFrame, by: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """``values`` (by..., pos, ...) with (song_idx, start): the song whose slice holds the
    position, i.e. that with the last start at or before it, of equal starts the last
    song (the others are empty). Values before the first start have no owner and no row.

    An as-of join without a range condition, and without a row per position of a song:
    positions are cut into blocks of ``span``, starts and values of a block are put in
    order in one task, and what a block gets from the blocks before it is the last
    start of these, found on one row per block (in blocks of blocks). A song that owns
    a third of all values lies in many blocks.
    """
    by = list(by)
    firsts = starts.groupBy(*by, "pos").agg(F.max("song_idx").alias("song_idx"))
    own = F.struct("pos", "song_idx")
    block = F.expr(f"cast(floor(pos / {span}) as bigint)")
    held = [c for c in values.columns if c not in (*by, "pos")]
    rows = (firsts.select(*by, "pos", own.alias("own"), *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in held])
                  .unionByName(values.withColumn("own", F.lit(None).cast(firsts.select(own.alias("own")).schema["own"].dataType))
                                     .select(*by, "pos", "own", *held)).withColumn("block", block))
    blocks = rows.groupBy(*by, "block").agg(F.max("own").alias("last")).withColumn("over", F.expr(f"cast(floor(block / {span}) as bigint)"))
    before = Window.unboundedPreceding, -1
    inner = F.last("last", ignorenulls=True).over(Window.partitionBy(*by, "over").orderBy("block").rowsBetween(*before))
    overs = blocks.groupBy(*by, "over").agg(F.max("last").alias("m"))
    above = F.last("m", ignorenulls=True).over(Window.partitionBy(*by).orderBy("over").rowsBetween(*before))
    carried = (blocks.withColumn("inner", inner).join(overs.withColumn("above", above).drop("m"), [*by, "over"])
                     .select(*by, "block", F.coalesce("inner", "above").alias("carry")))
    here = Window.partitionBy(*by, "block").orderBy("pos", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("seen", F.last("own", ignorenulls=True).over(here)).filter(F.col("own").isNull())
    return (placed.join(carried, [*by, "block"]).withColumn("owner", F.coalesce("seen", "carry")).filter(F.col("owner").isNotNull())
                  .select(*by, "pos", F.col("owner.song_idx").alias("song_idx"), F.col("owner.pos").alias("start"), *held))


def catalogue_join(metadata: DataFrame, analysis: DataFrame, musicbrainz: DataFrame | None = None) -> DataFrame:
    """One wide row per song: the groups joined on their row position ``song_idx``."""
    out = metadata.join(analysis, "song_idx")
    return out.join(musicbrainz, "song_idx") if musicbrainz is not None else out


def catalogue_count(songs: DataFrame) -> DataFrame:
    return songs.agg(F.count(F.lit(1)).alias("num_songs"))


def catalogue_fields(songs: DataFrame, fields: Sequence[str], song_idx: int | None = None) -> DataFrame:
    """(song_idx, fields...) for all songs, or one song position."""
    out = songs.select("song_idx", *fields)
    return out if song_idx is None else out.filter(F.col("song_idx") == song_idx)


def ragged_bounds(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """(song_idx, start, end): a song's values run to the start of the next song in
    order of position, or to the end of the flat table for the last song.

    Positions may have gaps. The songs are numbered in order without a single-task
    window, and the next start is that of the following number.
    """
    numbered = global_index(offsets.select("song_idx", F.col("idx").cast("long").alias("start")), ["song_idx"], "_n")
    numbered = numbered.checkpoint(eager=True)
    nxt = numbered.select((F.col("_n") - 1).alias("_n"), F.col("start").alias("_next"))
    total = flat.agg((F.max("pos") + 1).alias("_end")).first()["_end"] or 0
    return numbered.join(nxt, "_n", "left").select("song_idx", "start", F.coalesce("_next", F.lit(int(total))).alias("end"))


def ragged_slice_long(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """(song_idx, i, value): each song's slice of the flat values, position i from 0.

    Offsets rise with the songs' positions; the range condition start <= pos < next
    start is the as-of join ``owner_of``.
    """
    starts = offsets.select(F.col("idx").cast("long").alias("pos"), "song_idx")
    return owner_of(starts, flat.select("pos", "value")).select("song_idx", (F.col("pos") - F.col("start")).alias("i"), "value")


def ragged_slice(offsets: DataFrame, flat: DataFrame) -> DataFrame:
    """(song_idx, values ARRAY): each song's slice as one array, in position order."""
    long = ragged_slice_long(offsets, flat)
    return long.groupBy("song_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("values"))


def song_idx_lookup(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """(song_id, song_idx): positions of the listed songs; a repeated ID keeps the last."""
    return (songs.select("song_id", "song_idx")
                 .join(ids.select("song_id").distinct(), "song_id", "left_semi")
                 .groupBy("song_id").agg(F.max("song_idx").alias("song_idx")))


def song_index_of(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """(song_id, song_idx) per distinct ID of ``ids`` (song_id): its first position,
    null when absent (not 0)."""
    first = songs.groupBy("song_id").agg(F.min("song_idx").alias("song_idx"))
    return ids.select("song_id").distinct().join(first, "song_id", "left")


def song_details(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """(song_id, artist_name, release, title, track_id) for the listed song IDs."""
    return songs.join(ids.select("song_id").distinct(), "song_id").select(
        "song_id", "artist_name", "release", "title", "track_id")


def artist_terms(terms: DataFrame, freq: DataFrame, weight: DataFrame) -> DataFrame:
    """(track_id, pos, term, freq, weight): three arrays matched by position."""
    return (terms.select("track_id", "pos", "term")
                 .join(freq.select("track_id", "pos", "freq"), ["track_id", "pos"])
                 .join(weight.select("track_id", "pos", "weight"), ["track_id", "pos"]))


def similar_artists(rows: DataFrame) -> DataFrame:
    """(track_id, pos, artist): one column of names per track, position kept."""
    return rows.select("track_id", "pos", "artist")


def artist_mbtags(tags: DataFrame, counts: DataFrame) -> DataFrame:
    """(track_id, pos, tag, count): tags with their counts; a track with no tags has no rows."""
    return tags.join(counts.select("track_id", "pos", "count"), ["track_id", "pos"], "left")


def track_records(terms: DataFrame, similar: DataFrame) -> DataFrame:
    """(track_id, artist_terms ARRAY<STRUCT<term,freq,weight>>, similar_artists ARRAY<STRING>).

    One nested row per track; each array is as long as that track's own list.
    """
    t = terms.groupBy("track_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "freq", "weight"))),
                    lambda s: F.struct(s["term"].alias("term"), s["freq"].alias("freq"),
                                       s["weight"].alias("weight"))).alias("artist_terms"))
    s = similar.groupBy("track_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "artist"))), lambda x: x["artist"])
         .alias("similar_artists"))
    return t.join(s, "track_id", "full")

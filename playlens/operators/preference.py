"""Preference: mean-centred counts, like/dislike classes, song liking, user correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIKED = "liked"
DISLIKED = "disliked"
NEUTRAL = "neutral"


def _center(plays: DataFrame, key: str, stats: DataFrame | None) -> DataFrame:
    if stats is None:
        # Mean from the same rows: partial sums per key, then joined back on the
        # key (a shuffle join on the key, skew-split by AQE); no per-key window,
        # which would hold a hot key's rows in one task.
        stats = plays.groupBy(F.col(key).alias("id")).agg(F.avg(F.col("play_count").cast("double")).alias("mean"))
    means = stats.select(F.col("id").alias(key), F.col("mean").cast("double").alias("_mean"))
    return plays.join(means, key).select(
        "user_id", "item_id", (F.col("play_count") - F.col("_mean")).alias("score"))


def center_by_user(plays: DataFrame, user_stats: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score = play_count - user mean); users without a mean drop out."""
    return _center(plays, "user_id", user_stats)


def center_by_item(plays: DataFrame, item_stats: DataFrame | None = None,
                   raw_order: bool = False) -> DataFrame:
    """(user_id, item_id, score = play_count - song mean).

    ``raw_order=True`` gives the reference's file order (item_id, user_id, score).
    """
    out = _center(plays, "item_id", item_stats)
    return out.select("item_id", "user_id", "score") if raw_order else out


def preference_class(centred: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """Add ``preference``: liked (> t), disliked (< -t), neutral (strictly between);
    exactly +t or -t belongs to no class (null)."""
    s = F.col(score)
    cls = (F.when(s > threshold, F.lit(LIKED))
            .when(s < -threshold, F.lit(DISLIKED))
            .when((s < threshold) & (s > -threshold), F.lit(NEUTRAL)))
    return centred.withColumn("preference", cls)


def liked(centred: DataFrame, threshold: float = 0.5) -> DataFrame:
    return centred.filter(F.col("score") > threshold)


def disliked(centred: DataFrame, threshold: float = 0.5) -> DataFrame:
    return centred.filter(F.col("score") < -threshold)


def neutral(centred: DataFrame, threshold: float = 0.5) -> DataFrame:
    return centred.filter((F.col("score") < threshold) & (F.col("score") > -threshold))


def item_liking(plays: DataFrame, liked_above: int = 10, disliked_at_most: int = 3,
                n_listeners: int | None = None) -> DataFrame:
    """(item_id, liked, not_liked, total, liking_percent, listen_percent).

    liked = rows with play > liked_above, not_liked = rows with play <=
    disliked_at_most; songs with only counts in between do not appear.
    liking_percent = liked / total (a fraction). listen_percent = total / number
    of distinct users (or ``n_listeners``). One aggregate pass instead of two
    filtered counts and a full outer join.
    """
    p = F.col("play_count")
    per_item = (plays.groupBy("item_id")
                     .agg(F.count_if(p > liked_above).alias("liked"),
                          F.count_if(p <= disliked_at_most).alias("not_liked"))
                     .withColumn("total", F.col("liked") + F.col("not_liked"))
                     .filter(F.col("total") > 0))
    out = per_item.withColumn("liking_percent", F.col("liked") / F.col("total"))
    if n_listeners is None:
        # One scalar action: the number of distinct users (partial-aggregated).
        n_listeners = plays.select("user_id").distinct().count()
    return out.withColumn("listen_percent", F.col("total") / F.lit(float(n_listeners)))


def liking_outer_join(plays: DataFrame, liked_above: int = 10, disliked_at_most: int = 3) -> DataFrame:
    """The literal two-count + full outer join form of the liking report
    (item_id, liked, not_liked, total, liking_percent)."""
    likes = plays.filter(F.col("play_count") > liked_above).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("liked"))
    dislikes = plays.filter(F.col("play_count") <= disliked_at_most).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("not_liked"))
    both = likes.join(dislikes, "item_id", "full").na.fill(0, ["liked", "not_liked"])
    return (both.withColumn("total", F.col("liked") + F.col("not_liked"))
                .withColumn("liking_percent", F.col("liked") / F.col("total")))


#: Large users (more songs than ``block_songs``) are sent to all tasks up to so many.
_BROADCAST_USERS = 1_000_000


def user_similarity(centred: DataFrame, pairs: DataFrame, form: str = "aligned", block_songs: int = 100_000) -> DataFrame:
    """Pearson-style correlation of centred play vectors for the given user pairs.

    pairs: (user_u, user_v). ``aligned`` sums u_i * v_i over shared songs and
    divides by the full norms; ``crosssum`` is the reference's literal formula,
    (sum u)(sum v) / (|u| |v|). A user whose centred vector is all zero gives null. Only the requested pairs are formed (keyed
    joins), never all user pairs. A user of more than ``block_songs`` songs is cut into
    blocks of songs and the user's pairs are dealt to the blocks; dot products are summed
    by block, so no join key holds more than about a block of one user.
    """
    norms = centred.groupBy("user_id").agg(F.sum("score").alias("_s"),
                                           F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_n"))
    nu = norms.select(F.col("user_id").alias("user_u"), F.col("_s").alias("_su"), F.col("_n").alias("_nu"))
    nv = norms.select(F.col("user_id").alias("user_v"), F.col("_s").alias("_sv"), F.col("_n").alias("_nv"))
    base = pairs.select("user_u", "user_v").join(nu, "user_u").join(nv, "user_v") \
                .withColumn("_den", F.nullif(F.col("_nu") * F.col("_nv"), F.lit(0.0)))
    if form == "crosssum":
        return base.select("user_u", "user_v",
                           (F.col("_su") * F.col("_sv") / F.col("_den")).alias("similarity"))
    if form != "aligned":
        raise ValueError("form must be 'aligned' or 'crosssum'")
    return base.join(_dots(centred, pairs, block_songs), ["user_u", "user_v"], "left").select(
        "user_u", "user_v",
        (F.coalesce("_dot", F.lit(0.0)) / F.col("_den")).alias("similarity"))


def _dots(centred: DataFrame, pairs: DataFrame, block_songs: int) -> DataFrame:
    """(user_u, user_v, _dot): sums of products over the songs both users have."""
    size = centred.agg(F.count(F.lit(1))).first()[0]
    blocks = (centred.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > block_songs)
                     .select(F.col("user_id").alias("user_u"), F.ceil(F.col("_c") / F.lit(block_songs)).cast("int").alias("_blocks")))
    if size // max(1, block_songs) <= _BROADCAST_USERS:  # no more users can be that large
        blocks = F.broadcast(blocks)
    block = F.pmod(F.xxhash64("item_id"), F.coalesce("_blocks", F.lit(1))).cast("int")
    cu = (centred.select(F.col("user_id").alias("user_u"), "item_id", F.col("score").alias("_x"))
                 .join(blocks, "user_u", "left").withColumn("_block", block).drop("_blocks"))
    cv = centred.select(F.col("user_id").alias("user_v"), "item_id", F.col("score").alias("_y"))
    dealt = (pairs.select("user_u", "user_v").join(blocks, "user_u", "left")
                  .withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks"))
    return (dealt.join(cu, ["user_u", "_block"]).join(cv, ["user_v", "item_id"])
                 .groupBy("user_u", "user_v").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot")))

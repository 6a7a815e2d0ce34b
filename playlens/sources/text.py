"""Readers and writers of the reference's text formats, and the group store.

Readers declare their schema (nothing is inferred) and read in parallel splits;
writers write part files from the executors (nothing is collected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLET_SCHEMA = "user_id STRING, item_id STRING, play_count INT"
STATS_SCHEMA = "id STRING, total_play BIGINT, occurrence BIGINT, mean DOUBLE"
GROUP_STORE_SCHEMA = ("group_id BIGINT, user_id BIGINT, item_id BIGINT, play_count INT, "
                      "group_size INT, split STRING")


def read_triplets_text(spark: SparkSession, path: str, sep_regex: str = r"\W+",
                       strict: bool = True) -> DataFrame:
    """Triplet lines split on a regex (non-word characters by default).

    Fields after the third are ignored. ``strict``: a bad count fails the job
    (ANSI cast); otherwise it becomes null.
    """
    parts = F.split(F.trim(F.col("value")), sep_regex)
    count = parts.getItem(2).cast("int") if strict else parts.getItem(2).try_cast("int")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        parts.getItem(0).alias("user_id"), parts.getItem(1).alias("item_id"), count.alias("play_count"))


def read_triplets_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """Triplet lines split on runs of white space."""
    return read_triplets_text(spark, path, r"\s+")


def read_triplets_csv(spark: SparkSession, path: str, sep: str = "\t", header: bool = True,
                      mode: str = "FAILFAST") -> DataFrame:
    """Delimited triplets with a header and an explicit schema (nullable)."""
    return (spark.read.schema("user_id STRING, item_id STRING, play_count INT")
                 .option("header", header).option("sep", sep).option("mode", mode).csv(path))


def read_stats_text(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated statistics: id, total_play, occurrence, mean (BIGINT totals)."""
    return spark.read.schema(STATS_SCHEMA).option("sep", " ").option("mode", "FAILFAST").csv(path)


def read_space_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated triplets with no header (the pandas-side reader)."""
    return spark.read.schema(TRIPLET_SCHEMA).option("sep", " ").option("mode", "FAILFAST").csv(path)


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triplets, user stats, song stats) from one folder."""
    f = folder.rstrip("/")
    return (read_space_triplets(spark, f"{f}/train_triplets.txt"),
            read_stats_text(spark, f"{f}/user_play_mean.txt"),
            read_stats_text(spark, f"{f}/song_play_mean.txt"))


def register_dataset(spark: SparkSession, folder: str, prefix: str = "") -> tuple[str, str, str]:
    """Register the three tables of ``load_dataset`` as the temporary views
    ``triplets``, ``user_stats`` and ``song_stats`` (after ``prefix``); their names.
    Views of these names are replaced."""
    names = tuple(prefix + n for n in ("triplets", "user_stats", "song_stats"))
    for name, df in zip(names, load_dataset(spark, folder), strict=True):
        df.createOrReplaceTempView(name)
    return names


def write_subsets(tagged: DataFrame, root: str) -> None:
    """Triplets of every subset under ``root/subset=<name>/`` (one write, partitioned)."""
    tagged.select("subset", F.concat_ws(" ", *[F.col(c).cast("string") for c in
                                                ("user_id", "item_id", "play_count")]).alias("value")) \
          .write.mode("errorifexists").partitionBy("subset").text(root)


def load_subsets(spark: SparkSession, root: str, subsets: list[str] | None = None) -> DataFrame:
    """All subsets' triplets as one table with a ``subset`` partition column.

    ``subsets`` picks some of them; the filter prunes the other folders.
    """
    parts = F.split(F.col("value"), " ")
    df = spark.read.text(root)
    if subsets is not None:
        df = df.filter(F.col("subset").isin(list(subsets)))
    return df.select("subset", parts.getItem(0).alias("user_id"), parts.getItem(1).alias("item_id"),
                     parts.getItem(2).cast("int").alias("play_count"))


def load_train_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    f = folder.rstrip("/")
    return (read_space_triplets(spark, f"{f}/train_triplets.txt"),
            read_space_triplets(spark, f"{f}/test_triplets.txt"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One ID per line, trimmed; blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter(F.col("id") != "")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """One integer play count per line."""
    return spark.read.schema("play_count INT").option("mode", "FAILFAST").csv(path)


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(path): files under ``folder`` (recursively) with the given extension.

    The binary content column is never selected, so it is not read.
    """
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", f"*.{extension}").load(folder).select("path"))


def write_triplets(df: DataFrame, path: str, cols=("user_id", "item_id", "play_count")) -> None:
    """Space-separated text of three columns, one part file per task."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value")) \
      .write.mode("errorifexists").text(path)


def write_stats(df: DataFrame, path: str) -> None:
    """Space-separated text of (id, total_play, occurrence, mean)."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "total_play", "occurrence", "mean")])
              .alias("value")).write.mode("errorifexists").text(path)


def save_groups(group_plays: DataFrame, path: str, group_size: int) -> None:
    """Store group plays, partitioned by group size and split (a rerun replaces the partitions it writes)."""
    (group_plays.withColumn("group_size", F.lit(int(group_size)))
                .select("group_id", "user_id", "item_id", "play_count", "group_size", "split")
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("group_size", "split").parquet(path))


def load_groups(spark: SparkSession, path: str, size: int = 4) -> DataFrame:
    """Stored group plays of one size; the size filter prunes partitions."""
    return (spark.read.schema(GROUP_STORE_SCHEMA).parquet(path)
                 .filter(F.col("group_size") == size)
                 .select("group_id", "split", "user_id", "item_id", "play_count"))

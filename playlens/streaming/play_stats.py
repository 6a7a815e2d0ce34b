"""Song statistics kept up to date while triplet files keep arriving.

The reference computes the per-song sum / count / mean once over a finished
file. The same aggregate as a Structured Streaming query: new text files in a
folder are parsed, the running per-song sums and counts live in the state store
(checkpointed to the shared folder, so a lost executor or a restart resumes),
and every micro-batch writes the songs that it changed to a folder of its own.
A repeated batch overwrites its own folder only, so a crash between two steps
loses nothing; ``read_song_play_mean`` takes each song's latest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.session import scratch_path
from playlens.sources.text import write_triplets


def parse_triplet_lines(lines: DataFrame, sep_regex: str = r"\W+") -> DataFrame:
    parts = F.split(F.trim(F.col("value")), sep_regex)
    return lines.filter(F.trim("value") != "").select(
        parts.getItem(0).alias("user_id"), parts.getItem(1).alias("item_id"),
        parts.getItem(2).cast("int").alias("play_count"))


def start_song_play_mean(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                         available_now: bool = True, files_per_batch: int | None = None):
    """Start the streaming aggregate; returns the StreamingQuery."""
    source = spark.readStream.schema("value STRING")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    per_song = (parse_triplet_lines(source.text(source_dir))
                .groupBy(F.col("item_id").alias("id"))
                .agg(F.sum("play_count").cast("bigint").alias("total_play"),
                     F.count(F.lit(1)).alias("occurrence")))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.withColumn("mean", F.col("total_play") / F.col("occurrence")) \
             .write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    writer = (per_song.writeStream.outputMode("update").foreachBatch(write_batch)
                      .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_song_play_mean(spark: SparkSession, out_dir: str) -> DataFrame:
    """(id, total_play, occurrence, mean): the latest row of each song."""
    rows = spark.read.parquet(out_dir)
    values = F.struct("total_play", "occurrence", "mean")
    return rows.groupBy("id").agg(F.max_by(values, "epoch").alias("v")).select("id", "v.*")


def run_song_play_mean_stream(spark: SparkSession, plays: DataFrame, n_files: int = 4) -> DataFrame:
    """Feed ``plays`` as text files, two to a batch, run the stream to the end, return
    the result table."""
    src = scratch_path(spark, "stream-in")
    # Several part files, as if they had arrived one by one.
    write_triplets(plays.repartition(n_files), src)
    out = scratch_path(spark, "stream-out")
    q = start_song_play_mean(spark, src, out, scratch_path(spark, "stream-ckpt"), files_per_batch=2)
    q.awaitTermination()
    return read_song_play_mean(spark, out)

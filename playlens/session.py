"""Session set-up and the shared folder used for checkpoints and scratch output."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_ROOT: str | None = None
_SHIPPED: set[str] = set()


def get_session(master: str | None = None, app_name: str = "playlens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for these jobs; on a cluster pass ``master=None``.

    AQE stays on (coalescing, skew-join splitting, broadcast switch at run
    time); the UI stays off.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # A number of shuffle partitions only where it is asked for, or on one machine;
    # elsewhere the cluster's setting holds.
    asked = shuffle_partitions or os.environ.get("PLAYLENS_SHUFFLE_PARTITIONS")
    if asked or (master or "").startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", str(asked or 8))
    builder = (builder
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("PLAYLENS_DRIVER_MEMORY", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only where none is configured.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
    system). Only a local-mode session without that setting (tests, bench) gets
    a fresh folder under the system temp directory.
    """
    global _LOCAL_CHECKPOINT_ROOT
    sc = spark.sparkContext
    ship_package(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running playlens jobs")
    if _LOCAL_CHECKPOINT_ROOT is None:
        _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="playlens-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_ROOT)
    return sc.getCheckpointDir() or _LOCAL_CHECKPOINT_ROOT


def ship_package(spark: SparkSession) -> None:
    """Make ``playlens`` importable in the Python workers (pandas UDF tasks).

    The package is zipped once per SparkContext and added with ``addPyFile``,
    which Spark copies to every executor; the caller's working directory or
    PYTHONPATH does not matter.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="playlens-pkg-"), "playlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path beside the checkpoints for written tables."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once beside the checkpoints, by columns, and read back: what reads it
    several times doesn't make it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

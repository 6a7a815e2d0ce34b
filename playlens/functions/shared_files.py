"""Numpy arrays as files in the shared folder: written by tasks, mapped by tasks.

A folder is named by a URI below ``spark.checkpoint.dir``. On a file system that
is mounted (``file:``) arrays are memory-mapped; elsewhere they are read through
pyarrow's file systems. Files are written under a name of their own and renamed,
so a task that runs again (lost executor, speculation) leaves the same file.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid

import numpy as np
from pyspark.sql import SparkSession

from playlens.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def save(uri: str, name: str, array: np.ndarray) -> None:
    path = _local(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, array)
        os.replace(own, f"{path}/{name}.npy")
        return
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at, recursive=True)
    buf = io.BytesIO()
    np.save(buf, array)
    own = f"{at}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(buf.getvalue())
    store.move(own, f"{at}/{name}.npy")


def load(uri: str, name: str) -> np.ndarray:
    path = _local(uri)
    if path is not None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(f"{at}/{name}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def drop(uri: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = _local(uri)
    if path is not None:
        shutil.rmtree(path, ignore_errors=True)
        return
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(uri)
    store.delete_dir(at)

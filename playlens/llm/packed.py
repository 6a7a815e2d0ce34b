"""Counts of 64-bit keys, packed: sorted, delta-coded, compressed, sent by shard.

A task counts its own keys and sends each shard one row for many keys, which is a
fraction of the bytes of one row per key; a shard's rows are merged in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def _deflate(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _inflate(b: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).reshape(-1)


ROWS = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ROWS_SQL = "shard int, n long, keys binary, counts binary"


class Counter:
    """Counts of sorted keys within a task, sent by shard when many are held."""

    def __init__(self, limits: np.ndarray, most: int = 1 << 21):
        self.limits, self.most, self.held, self.size = limits, most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append(np.unique(keys, return_counts=True))
            self.size += len(self.held[-1][0])
        if self.size > self.most:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            k, c = _merge(self.held)
            cut = np.searchsorted(k, self.limits)
            for s, (keys, counts) in enumerate(zip(np.split(k, cut), np.split(c, cut), strict=True)):
                if len(keys):
                    delta = np.diff(keys, prepend=np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()),
                                                      pa.array([_deflate(delta)], pa.binary()), pa.array([_deflate(counts)], pa.binary())], schema=ROWS)
        self.held, self.size = [], 0


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    k = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")  # runs are sorted already
    k = k[order]
    c = c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a shard merged, a few at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for n, k, c in zip(b.column("n").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            held.append((np.cumsum(_inflate(k, n, np.uint64), dtype=np.uint64), _inflate(c, n, np.int64)))
            if len(held) >= 8:
                held = [_merge(held)]
    return _merge(held)

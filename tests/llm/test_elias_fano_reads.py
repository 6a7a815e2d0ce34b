"""Low parts of an Elias-Fano code are read as one number each, at every width."""

import numpy as np
import pytest

from playlens.llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize("bits", [1, 7, 8, 17, 24, 31, 32, 33, 47, 51])
def test_low_parts_of_every_width(bits):
    rng = np.random.default_rng(bits)
    n = 3000
    v = np.sort(rng.integers(0, n << bits, n, dtype=np.uint64))
    ef = EliasFano(encode(v, n << bits))
    assert ef.low.ndim == 1 and ef.low.strides == (ef.width,)  # one read a value, no copy
    at = rng.permutation(n)
    assert np.array_equal(ef.access(at), v[at])
    assert np.array_equal(ef.access([n - 1]), v[-1:])
    x = np.concatenate([v, v + np.uint64(1), rng.integers(0, n << bits, 500, dtype=np.uint64)])
    x = x[x < np.uint64(n << bits)]
    place, equal = ef.successor(x)
    assert np.array_equal(place, np.searchsorted(v, x))
    assert np.array_equal(equal, np.isin(x, v))


def test_long_runs_of_equal_high_parts():
    rng = np.random.default_rng(4)
    v = np.unique(np.concatenate([rng.integers(0, 1 << 20, 60_000), (1 << 44) + rng.integers(0, 1 << 30, 5000)]).astype(np.uint64))
    ef = EliasFano(encode(v, 1 << 45))
    x = np.concatenate([v[::7], rng.integers(0, 1 << 45, 3000, dtype=np.uint64), rng.integers(0, 1 << 20, 3000, dtype=np.uint64)])
    rng.shuffle(x)
    place, equal = ef.successor(x)
    assert np.array_equal(place, np.searchsorted(v, x))
    assert np.array_equal(equal, np.isin(x, v))

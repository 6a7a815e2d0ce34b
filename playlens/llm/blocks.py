"""Words and shingles of Arrow text columns as 64-bit hashes, in numpy.

A batch is worked on in blocks of about 256 KB of text (one text may be
larger: it is cut at white space), so memory does not follow the batch or the
longest text. A word's hash comes from two polynomial hashes of its bytes,
mixed into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U64 = np.uint64
_RNG = np.random.default_rng(20240601)
_T1 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_T2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P1, _P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: White space as the contracts define it: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII letters folded to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Every ASCII character that is no letter and no digit separates words.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_lo:_hi] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(p)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 65536)
        inv = pow(p, -1, 1 << 64)
        a, b = np.full(size, p, np.uint64), np.full(size, inv, np.uint64)
        a[0] = b[0] = 1
        have = _POW[p] = (np.multiply.accumulate(a), np.multiply.accumulate(b))
        if size > 4 * BLOCK:
            _POW.pop(p)  # made for one very long piece only
    return have


def _hash_words(buf: np.ndarray, firsts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``buf``; ``firsts`` are the
    positions where texts begin."""
    n = len(buf)
    word = ~sep[buf]
    head = word.copy()
    head[1:] &= ~word[:-1]
    begins = firsts[firsts < n]
    head[begins] = word[begins]
    starts = np.flatnonzero(head)
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    ends_at = begins[begins > 0] - 1
    tail[ends_at] = word[ends_at]
    ends = np.flatnonzero(tail)
    folded = FOLD[buf]
    h = None
    for table, p in ((_T1, _P1), (_T2, _P2)):
        pw, inv = _powers(p, n + 1)
        s = np.empty(n + 1, np.uint64)
        s[0] = 0
        x = table[folded]
        x *= pw[:n]
        np.cumsum(x, out=s[1:])
        part = mix((s[ends + 1] - s[starts]) * inv[starts])
        h = part if h is None else mix(h ^ (part + U64(0x632BE59BD9B4E019)))
    return h, starts


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def word_blocks(col: pa.Array, sep: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, word hashes, words per text) for runs of texts."""
    raw, off = text_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        if off[j] - off[i] > 2 * BLOCK:  # one long text: cut at separators
            parts, at, end = [], int(off[i]), int(off[j])
            while at < end:
                to = min(end, at + BLOCK)
                while to < end and not sep[raw[to]]:
                    to += 1
                parts.append(_hash_words(raw[at:to], np.zeros(1, np.int64), sep)[0])
                at = to
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield i, j, h, np.array([len(h)])
        else:
            piece = raw[off[i]:off[j]]
            begins = off[i:j] - off[i]
            if len(piece):
                h, starts = _hash_words(piece, begins, sep)
                at = np.searchsorted(starts, np.append(begins, len(piece)))
                yield i, j, h, np.diff(at)
            else:
                yield i, j, np.zeros(0, np.uint64), np.zeros(j - i, np.int64)
        i = j


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingles per text): ``k`` words each, in order of place;
    a text of fewer words has its whole sequence as one, a text without words none."""
    ends = np.cumsum(counts)
    begins = ends - counts
    out_n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    total = int(out_n.sum())
    out = np.empty(total, np.uint64)
    place = np.cumsum(out_n) - out_n
    if len(h) >= k:
        g = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            g = g * U64(0x9DDFEA08EB382D69) + h[j:len(h) - k + 1 + j]
            g ^= g >> U64(29)
        g = mix(g)
        full = counts >= k
        idx = np.repeat(begins[full] - place[full], out_n[full]) + np.flatnonzero(np.repeat(full, out_n))
        out[np.repeat(full, out_n)] = g[idx]
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        c = int(counts[t])
        g = np.full(1, c, np.uint64)
        for x in h[begins[t]:ends[t]]:
            g = g * U64(0x9DDFEA08EB382D69) + x
            g ^= g >> U64(29)
        out[place[t]] = mix(g)[0]
    return out, out_n


def distinct_sets(col: pa.Array, k: int, sep: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the batch, sorted distinct shingle hashes) of each text."""
    for i, j, h, counts in word_blocks(col, sep):
        s, n = shingles(h, counts, k)
        owner = np.repeat(np.arange(j - i), n)
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        if len(s):
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
            s, owner = s[new], owner[new]
        at = np.searchsorted(owner, np.arange(j - i + 1))
        for t in range(j - i):
            yield i + t, s[at[t]:at[t + 1]]

"""Elias-Fano coding of a monotone sequence, read in place (memory-mapped).

A value's ``l`` low bits lie in an array of whole bytes, with some bytes after the last
so that every value can be read as one number; its high part is written in unary into a
bit vector with counts of ones and zeros every 512 bits. All operations are over arrays
of queries.
"""

from __future__ import annotations

import numpy as np

_STEP = 512
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _r] = _i
_CHUNK = 1 << 17
#: Bytes after the last low part.
_AFTER = 8
#: Ranges of so few places are searched place by place.
_SHORT = 4
#: Every second byte, and one in each pair of bytes.
_PAIRS, _EACH_PAIR = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)
#: Top bit of each pair of bytes, and 64 in each byte.
_TOP_PAIRS, _FULL = np.uint64(0x8000800080008000), np.uint64(0x4040404040404040)
#: One in each byte, and each byte's top bit.
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the code of sorted uint64 ``values`` below ``universe``."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    top = (universe - 1) >> low_bits
    size = -(-(n + top + 1) // _STEP) * _STEP
    bits = np.zeros(size, bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = bits.reshape(-1, _STEP).sum(axis=1, dtype=np.int64)
    ones = np.concatenate([[0], np.cumsum(ones)])
    width = -(-low_bits // 8)
    low = np.zeros(n * width + _AFTER, np.uint8)
    for j in range(width):
        part = (values >> np.uint64(8 * j)).astype(np.uint8)
        spare = low_bits - 8 * j
        low[j:n * width:width] = part & np.uint8((1 << min(8, spare)) - 1)
    return {"words": words, "ones": ones, "low": low, "meta": np.array([n, low_bits, top], np.int64)}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.l, self.top = (int(x) for x in parts["meta"])
        parts = {k: np.asarray(a) for k, a in parts.items()}  # mapped files as plain arrays
        self.words = parts["words"].reshape(-1, _STEP // 64)
        self.ones = parts["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * _STEP - self.ones
        self.width = -(-self.l // 8)
        # the low parts where they lie, each read as a number with what stands after it, which ``mask`` takes off
        kind = np.uint32 if self.l <= 32 else np.uint64
        self.mask = kind((1 << self.l) - 1)
        self.low = np.ndarray(self.n, kind, parts["low"], 0, (self.width,)) if self.width else None

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero with ``flip``."""
        block = np.searchsorted(directory, k, "right") - 1
        r = (k - directory[block]).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]).view(np.uint64).reshape(-1)  # eight side by side
        if flip:
            counts = _FULL - counts
        # the pair of words: sums up to each pair side by side; then the word of the pair
        sums = ((counts & _PAIRS) + ((counts >> np.uint64(8)) & _PAIRS)) * _EACH_PAIR
        shift = np.bitwise_count((((r * _EACH_PAIR) | _TOP_PAIRS) - sums) & _TOP_PAIRS).astype(np.uint64) << np.uint64(4)
        r -= ((sums << np.uint64(16)) >> shift) & np.uint64(0xFFFF)
        first = (counts >> shift) & np.uint64(255)
        second = r >= first
        r -= np.where(second, first, np.uint64(0))
        at = (shift >> np.uint64(3)).astype(np.int64) + second
        word = self.words.reshape(-1)[block * (_STEP // 64) + at]
        if flip:
            word = ~word
        # the byte of the word: sums of the bytes' counts side by side in 64 bits
        sums = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _EACH
        byte = np.bitwise_count((((r * _EACH) | _TOP) - sums) & _TOP).astype(np.uint64)
        shift = byte << np.uint64(3)
        r = (r - (((sums << np.uint64(8)) >> shift) & np.uint64(255))).astype(np.int64)
        value = ((word >> shift) & np.uint64(255)).astype(np.int64)
        return block * _STEP + at * 64 + shift.astype(np.int64) + _SELECT[value, r]

    def _run(self, at: np.ndarray, flip: bool = False) -> np.ndarray:
        """How many ones (zeros with ``flip``) stand from position ``at`` on; 64 means 64 or more."""
        flat = self.words.reshape(-1)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        one = flat[np.minimum(word, len(flat) - 1)]
        more = np.where(word + 1 < len(flat), flat[np.minimum(word + 1, len(flat) - 1)], np.uint64(0))
        if flip:
            one, more = ~one, ~more
        one = one >> bit
        zeros = ~(one | ((more << (np.uint64(63) - bit)) << np.uint64(1)))
        lowest = zeros & (~zeros + np.uint64(1))
        return np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)  # without a zero: all 64 bits

    def _part(self, i: np.ndarray) -> np.ndarray:
        """The low parts at places ``i``, in the type of ``mask``."""
        return self.low[i] & self.mask if self.width else np.zeros(len(i), self.mask.dtype)

    def _low(self, i: np.ndarray) -> np.ndarray:
        return self._part(i).astype(np.uint64)

    def _wanted(self, x: np.ndarray) -> np.ndarray:
        """The low parts of the values ``x``."""
        return x.astype(self.mask.dtype) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low(i)

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and ``i + 1``: one select, the next one's bit is
        found from there."""
        at = self._select(i, self.ones, False)
        gap = self._run(at + 1, True)
        after = at + 1 + gap
        far = np.flatnonzero(gap >= 64)
        if len(far):
            after[far] = self._select(i[far] + 1, self.ones, False)
        high = [(at - i).astype(np.uint64), (after - i - 1).astype(np.uint64)]
        first, last = ((h << np.uint64(self.l)) | self._low(j) for h, j in zip(high, (i, i + 1), strict=True))
        return first.astype(np.int64), last.astype(np.int64)

    def within(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of ``x`` among the places [lo, hi), -1 where it isn't there: the successor
        search, confined to a range that is known to hold ``x`` if any does."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        for a in range(0, len(x), _CHUNK):
            part = slice(a, a + _CHUNK)
            long = hi[part] - lo[part] > _SHORT
            at = np.flatnonzero(long) + a
            if len(at):
                place, equal = self._successor(x[at], lo[at], hi[at])
                out[at] = np.where(equal, place, -1)
            at = np.flatnonzero(~long) + a
            if len(at):
                out[at] = self._short(x[at], lo[at], hi[at])
        return out

    def _short(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """``within`` for ranges of at most _SHORT places: where low bits agree, the high
        bits do if the value's bit stands at its position and is that place's one."""
        out = np.full(len(x), -1, np.int64)
        want, high = self._wanted(x), (x >> np.uint64(self.l)).astype(np.int64)
        go = np.flatnonzero(lo < hi)
        for j in range(_SHORT):
            place = lo[go] + j
            same = self._part(place) == want[go]
            at, i = go[same], place[same]
            ok = self._is_one(high[at] + i, i)
            out[at[ok]] = i[ok]
            go = go[(place + 1 < hi[go]) & (out[go] < 0)]
        return out

    def _is_one(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether position ``at`` holds the k-th (from 0) one."""
        inside = at < self.words.size * 64
        at = np.where(inside, at, 0)
        block, bit = at // _STEP, (at & 63).astype(np.uint64)
        w, word = self.words[block], (at % _STEP) >> 6
        own = w[np.arange(len(at)), word]
        # ones in the words before: eight counts side by side, added in pairs, then all at once
        counts = np.bitwise_count(w).reshape(-1).view(np.uint64) & ((np.uint64(1) << (word << 3).astype(np.uint64)) - np.uint64(1))
        whole = (((counts & _PAIRS) + ((counts >> np.uint64(8)) & _PAIRS)) * _EACH_PAIR) >> np.uint64(48)
        rank = self.ones[block] + whole.astype(np.int64) + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
        return inside & ((own >> bit) & np.uint64(1) == 1) & (rank == k)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it equals x); n where none is."""
        x = np.asarray(x, np.uint64)
        place, equal = np.empty(len(x), np.int64), np.empty(len(x), bool)
        for a in range(0, len(x), _CHUNK):
            place[a:a + _CHUNK], equal[a:a + _CHUNK] = self._successor(x[a:a + _CHUNK])
        return place, equal

    def _successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        h = (x >> np.uint64(self.l)).astype(np.int64)
        beyond = h > self.top
        h = np.minimum(h, self.top)
        # the values with these high bits: a run of ones after the zero before it
        lo = np.zeros(len(x), np.int64)
        later = h > 0
        lo[later] = self._select(h[later] - 1, self.zeros, True) - (h[later] - 1)
        run = self._run(lo + h)
        long = np.flatnonzero(run >= 64)
        end = lo + run
        if len(long):
            end[long] = self._select(h[long], self.zeros, True) - h[long]
        if first is not None:
            lo, end = np.maximum(lo, first), np.minimum(end, last)
        want = self._wanted(x)
        go = np.flatnonzero(lo < end)
        a, b, w = lo[go], end[go], want[go]
        while len(go):
            mid = (a + b) >> 1
            less = self._part(np.minimum(mid, self.n - 1)) < w
            less &= a < b  # those found wait for the others
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            left = np.flatnonzero(a < b)
            if 2 * len(left) <= len(go):
                lo[go] = a
                go, a, b, w = go[left], a[left], b[left], w[left]
        equal = np.zeros(len(x), bool)
        inside = np.flatnonzero(lo < end)
        equal[inside] = self._part(lo[inside]) == want[inside]
        lo[beyond], equal[beyond] = self.n, False
        return lo, equal

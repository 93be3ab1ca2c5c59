"""Words of whole text batches as 64-bit hashes, vectorised.

A batch's texts lie behind each other in one byte buffer.  A table maps every
byte to a code; 0 separates words.  A word's hash is a polynomial over its
codes, taken from prefix sums modulo 2**64 and mixed at the end, so that a
batch costs a few passes over its bytes and no Python object for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _table(lower: bool = True) -> np.ndarray:
    out = np.arange(1, 257, dtype=np.uint16)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    if lower:
        out[65:91] += 32
    return out


#: Words [^\x20\x09-\x0D]+ with A-Z in lower case.
PLAIN = _table()


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(_WINDOW, n)
        have = np.empty(size, np.uint64)
        have[0] = 1
        k = 1
        while k < size:
            step = min(k, size - k)
            have[k : k + step] = have[:step] * np.uint64(pow(base, k, 1 << 64))
            k += step
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets that bound each (one more than texts). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def word_hashes(buf: np.ndarray, off: np.ndarray, table: np.ndarray = PLAIN, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each document's words), words in order.

    With prefix, the hash of each word's first bytes; shorter words keep their whole hash.
    """
    hashes, starts = [], []
    lo, n = 0, len(buf)
    inner = off[1:-1]
    while lo < n:
        size = _WINDOW
        while True:
            hi = min(n, lo + size)
            code = table[buf[lo:hi]]
            full = code != 0
            cut = inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, hi, "left")] - lo
            if hi == n or not full[-1] or table[buf[hi]] == 0:
                break
            zeros = np.flatnonzero(~full)  # the window ends inside a word: step back to a boundary
            back = max(int(zeros[-1]) + 1 if len(zeros) else 0, int(cut[-1]) if len(cut) else 0)
            if back:
                hi, code, full, cut = lo + back, code[:back], full[:back], cut[cut < back]
                break
            size *= 2
        m = hi - lo
        first = full.copy()
        first[1:] &= ~full[:-1]
        last = full.copy()
        last[:-1] &= ~full[1:]
        if len(cut):
            cut = cut[cut > 0]
            first[cut] = full[cut]
            last[cut - 1] = full[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if prefix:
            e = np.minimum(e, s + prefix - 1)
        term = code.astype(np.uint64) * _power(_BASE, m)
        total = np.cumsum(term)
        h = (total[e] - total[s] + term[s]) * _power(_INVERSE, m)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(s, off, "left")


def hash_word(word: bytes | str, table: np.ndarray = PLAIN) -> int:
    """The hash of one word."""
    word = word.encode() if isinstance(word, str) else word
    h, _ = word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]), table)
    return int(h[0])


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]

"""Vectorised word, shingle and MinHash kernels for Arrow batches of texts.

Everything works on the UTF-8 bytes of a whole batch at once, so a text costs a few
nanoseconds a byte.  Words are maximal runs of *word bytes*; A-Z are lower-cased.  Null
texts count as empty ones.  Memory is bounded by ``PIECE`` bytes of temporaries a piece
plus eight bytes a word of one chunk; a single text larger than a chunk is a chunk.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Bytes of text handled at once.
CHUNK = 1 << 20
PIECE = 1 << 18

_BYTES = np.arange(256)
#: Everything but ASCII white space (0x20, 0x09-0x0D).
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table() -> np.ndarray:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_VALUE = _table()[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        factor = np.full(max(n, PIECE), _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        factor[0] = 1
        _powers[which] = have = np.cumprod(factor, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """Words of a chunk of texts: hash, byte range and text number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, self.offsets, self.n_texts = data, offsets, len(offsets) - 1
        word = kind[data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | border[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | border[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.per_text = np.bincount(self.text, minlength=self.n_texts)
        self.hashes = self._hash(self.starts, self.ends)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the longer words, and their text numbers."""
        longer = self.ends - self.starts > size
        starts = self.starts[longer]
        return self._hash(starts, starts + size) ^ _U(size), self.text[longer]

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
            high = ends[to - 1]
            total = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_VALUE[self.data[low:high]] * _power("up", high - low)[: high - low], out=total[1:])
            s = starts[at:to] - low
            out[at:to] = (total[ends[at:to] - low] - total[s]) * _power("down", high - low + 1)[s]
            at = to
        return mix(out)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``size`` bytes: (from, to, bytes, offsets)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, in order.

    A text with fewer than ``width`` words, but at least one, has its whole sequence as its
    only shingle; a text without words has none.
    """
    h, text = words.hashes, words.text
    n = len(h) - width + 1
    if n > 0:
        same = text[:n] == text[width - 1 :]
        s = h[:n].copy()
        for j in range(1, width):
            s = s * _U(0xD6E8FEB86659FD93) + h[j : j + n]
        s, t = mix(s[same]), text[:n][same]
    else:
        s, t = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < width))
    if len(short):
        begin = np.cumsum(words.per_text) - words.per_text
        value = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = words.per_text[short] > j
            k = np.where(has, begin[short] + j, 0)
            value = np.where(has, value * _U(0xD6E8FEB86659FD93) + h[k], value)
        value = mix(value ^ (words.per_text[short].astype(np.uint64) << _U(56)) ^ _U(0xA5A5))
        s, t = np.concatenate([s, value]), np.concatenate([t, short])
        order = np.argsort(t, kind="stable")
        s, t = s[order], t[order]
    return s, t


def distinct(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted, and the offsets of the texts."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    offsets = np.zeros(n_texts + 1, dtype=np.int64)
    np.cumsum(np.bincount(t, minlength=n_texts), out=offsets[1:])
    return v, offsets


def reduce_texts(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over the values of each text; ``empty`` for texts without values."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    has = np.flatnonzero(np.diff(offsets))
    if len(has):
        out[has] = ufunc.reduceat(values, offsets[has])
    return out


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of ``n`` hash functions ``x * a + b``; a is odd."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(values: np.ndarray, offsets: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """MinHash minima, one row a text: the upper 32 bits of the smallest permuted value."""
    a, b = permutations(n, seed)
    out = np.empty((len(offsets) - 1, n), dtype=np.uint32)
    has = np.flatnonzero(np.diff(offsets))
    out[:] = np.iinfo(np.uint32).max
    at = offsets[has]
    if len(has):
        v = values ^ (values >> _U(29))
        for i in range(n):
            out[has, i] = np.minimum.reduceat((v * a[i] + b[i]) >> _U(32), at).astype(np.uint32)
    return out


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column of longs from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))

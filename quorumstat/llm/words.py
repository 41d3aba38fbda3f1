"""Words and word n-grams of whole Arrow columns, as numpy arrays.

Texts are handled as UTF-8 bytes. A word is a run of bytes outside ``\\x20\\x09-\\x0D``, so
its bounds equal those of the pattern ``[^\\x20\\x09-\\x0D]+`` on code points. Hashes have 64
bits and depend on the bytes alone: every task and every run gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, root: int, n: int) -> np.ndarray:
    """root ** 0 .. root ** (n - 1) modulo 2 ** 64; grown by doubling and kept."""
    p = _powers.get(name)
    if p is None:
        p = np.ones(1, dtype=np.uint64)
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(root, len(p), 1 << 64))])
    if len(p) <= 2 * SLICE_BYTES:
        _powers[name] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling, so that any bits of a hash may be used alone."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte bounds in ``data`` and the row of each word."""

    data: np.ndarray
    bounds: np.ndarray  # of the texts, n + 1
    start: np.ndarray
    end: np.ndarray
    fold: bool = False

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each text, n + 1 entries."""
        return np.searchsorted(self.start, self.bounds)

    @cached_property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        """One hash for each word; A-Z count as a-z if ``fold``."""
        n = len(self.data)
        h = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE_FOLDED if self.fold else _BYTE)[self.data] * _power("up", _ROOT, n), out=h[1:])
        return mix((h[self.end] - h[self.start]) * _power("down", _INVERSE, n + 1)[self.start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = max(0, len(self.start) - k + 1)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h += self.hash[i : i + n] * _STEP[i % 64] ^ np.uint64(i // 64)
        return mix(h), self.row[:n] == self.row[k - 1 :][:n]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(texts: pa.Array, fold: bool = False) -> Words:
    """Words of a string array; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("") if len(texts) else pa.array([], pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    bounds = off - off[0]
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    before[bounds[:-1]] = False  # a text begins
    start = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False)
    after[bounds[1:] - 1] = False  # a text ends (of an empty one: the text before it does)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, start, end, fold)


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to

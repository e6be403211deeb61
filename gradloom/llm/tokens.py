"""Words, characters and their hashes for Arrow text columns, a few megabytes at a time.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  Nothing here sees less than
whole texts: a slice holds whole documents, however long one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21

_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint8)
_SOLID = np.ones(256, bool)
_SOLID[_SPACES] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(20250301)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Stands before the first word of a text, and after its last.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its head and that of what follows."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, start of each text and the end of the last) of runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        past = max(row + 1, int(np.searchsorted(offsets, int(offsets[row]) + most, "right")) - 1)
        starts = offsets[row : past + 1].astype(np.int64)
        yield row, data[starts[0] : starts[-1]], starts - starts[0]
        row = past


def words(data: np.ndarray, starts: np.ndarray, of: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word, a run of the bytes that ``of`` marks."""
    solid = of[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1, np.searchsorted(starts, first, "right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, by in (("up", _BASE), ("down", _BACK)):
            run = np.full(n, by)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same wherever it stands."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[first]) * down[first])


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all windows of ``width`` words; a text with fewer words, but some, is one window."""
    counts = np.bincount(doc, minlength=n_docs)
    window = hashes[: max(len(hashes) - width + 1, 0)].copy()
    for k in range(1, width):
        window = chain(window, hashes[k : k + len(window)])
    whole = doc[: len(window)] == doc[width - 1 :] if len(window) else np.empty(0, bool)
    out, at = window[whole], doc[: len(window)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        ends = np.cumsum(counts)
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            h = hashes[ends[d] - counts[d] : ends[d]]
            value = h[:1]
            for x in h[1:]:
                value = chain(value, np.array([x]))
            extra[i] = chain(value, np.array([len(h)], np.uint64))[0]
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
    return out, at


_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case code point for every letter, 0 for anything else."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def characters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice, and where each text starts among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[starts]

"""Words, word hashes and shingles of whole Arrow text columns, as numpy arrays.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); A-Z are lower-cased before
hashing when asked for.  Texts are handled in chunks of about 1 MB, so a task's memory depends on the chunk
and on its largest single text, not on the size of a batch.  Spark uses Python workers again for later stages: an
operator that keeps memos hands them to ``keep``, and the next operator of another kind drops them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
HASH_BYTES = 1 << 18  # bytes that one running sum covers; the tables of powers are as long
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT: dict[tuple, object] = {}


def keep(key: tuple, make: Callable[[], object]) -> object:
    """``make()`` once per worker, until an operator of another kind drops it."""
    if key not in _KEPT:
        drop_kept(key[0])
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept(but: str = "") -> None:
    """Forget what other operators keep in this worker and give the memory back to the system."""
    gone = [k for k in _KEPT if k[0] != but]
    for k in gone:
        del _KEPT[k]
    if gone:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: it gives memory back by itself
            pass


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets) of slices of ``batch`` whose texts hold at most ``max_bytes`` (or one row).
    A null text counts as empty."""
    drop_kept()
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield (batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row number of every word, in order."""
    space = SPACE[data]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(data)]] = True
        after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, rows


def _powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, for the positions of one running sum."""
    if int(base) not in _POWERS:
        made = []
        for step in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            steps = np.full(HASH_BYTES + 1, step, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[int(base)] = (made[0], made[1])
    return _POWERS[int(base)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """64-bit hash of each byte span (in order of their starts), from running polynomial sums over blocks of the chunk;
    a span that reaches into further blocks goes on from block to block."""
    up, down = _powers(base)
    value = np.zeros(len(starts), dtype=np.uint64)
    going = np.zeros(0, dtype=np.int64)
    for lo in range(0, len(data), HASH_BYTES):
        block = data[lo:lo + HASH_BYTES]
        hi = lo + len(block)
        a, b = np.searchsorted(starts, [lo, hi])
        if a == b and not len(going):
            continue
        total = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:len(block)], out=total[1:])
        for i in going.tolist():
            more = int(total[min(int(ends[i]), hi) - lo]) * pow(int(base), lo - int(starts[i]), 1 << 64)
            value[i] = np.uint64((int(value[i]) + more) % (1 << 64))
        own, until = starts[a:b] - lo, np.minimum(ends[a:b], hi) - lo
        value[a:b] = (total[until] - total[own]) * down[own]
        going = np.concatenate([going[ends[going] > hi], a + np.flatnonzero(ends[a:b] > hi)])
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def longer(values: np.ndarray, reach: int, hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive ``hashes`` (ordered), rolled on from those of every ``reach`` < n."""
    count = max(0, len(hashes) - n + 1)
    values = values[:count]
    for j in range(reach, n):
        values = mix(values * np.uint64(0x2545F4914F6CDD1D) + hashes[j:j + count])
    return values


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes (ordered); one per start that has n of them."""
    return longer(hashes, 1, hashes, n)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of each text, sorted by row, then hash.  A text with
    fewer words has its whole sequence as one shingle; one without words has none."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    values = sequence_hashes(words, n)
    inside = rows[:len(values)] == rows[n - 1:] if len(values) else np.zeros(0, dtype=bool)
    values, owner = values[inside], rows[:len(inside)][inside]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [sequence_hashes(words[first[r]:first[r + 1]], int(counts[r]))[0] + np.uint64(counts[r])
                 for r in short]
        values = np.concatenate([values, mix(np.array(whole, dtype=np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]  # radix sort: rows are small integers
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], owner[fresh]

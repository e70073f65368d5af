"""Array-at-a-time word handling for Arrow batches of UTF-8 text.

The text operators run inside `mapInArrow`. A batch is cut into blocks of a few megabytes so that
the per-byte work arrays stay small whatever the batch holds; all splitting and hashing is done on
the UTF-8 bytes of a block with numpy, never per character.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
_U = np.uint64


def release_memory() -> None:
    """Give freed memory back to the system, as workers live on and wait for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that releases memory when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def byte_table(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Word separators of the contracts: space and tab to carriage return.
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")

#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes inside each text: starts, ends, and the first run of each text."""
    n = len(keep)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(keep[:-1], out=first[1:])
    at = offsets[:-1]
    first[at[at < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:]
    last[:-1] |= ~keep[1:]
    first &= keep
    last &= keep
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~space[data], offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers), in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@functools.lru_cache(32)
def keys(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, drawn by the seed."""
    return np.random.default_rng([0x5EED, seed]).integers(0, 1 << 64, n, dtype=np.uint64) | _U(1)


#: Of each lane, the bytes that a span fills: none to all eight.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LANES = 8  # spans of more lanes are hashed by XXH64


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; the same bytes hash alike everywhere with one seed.

    A span is read in lanes of 8 bytes, each of which goes through a product with a drawn number and the finaliser before
    the next one, so no structure of a span's bytes adds up to nothing; spans of one length and at most 8
    bytes never collide. Longer ones do with a chance of about 2**-64 a pair. Results that must be exact compare bytes,
    as `DistinctTable` does; where hashes alone decide, callers draw the seed anew in each run.
    """
    n = ends - starts
    drawn = keys(seed, LANES + 1)
    h = n.astype(np.uint64) * drawn[LANES]
    if not len(n):
        return h
    lanes = _lanes(np.concatenate([data, np.zeros(8, np.uint8)]))
    own, at, left = np.arange(len(n)), starts, n
    for k in range(LANES):
        x = lanes[at]
        x &= _FILLED[np.minimum(left, 8)]
        x ^= h[own]
        x *= drawn[k]
        h[own] = mix(x)
        more = left > 8
        if not more.any():
            return h
        own, at, left = own[more], at[more] + 8, left[more] - 8
    view = memoryview(np.ascontiguousarray(data))
    for i in own.tolist():
        h[i] = xxhash.xxh64_intdigest(view[starts[i] : ends[i]], seed)
    h[own] = mix(h[own])
    return h


def window_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every `width` consecutive word hashes; element i covers i .. i + width - 1. Each place has a factor of its own."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, own = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k, factor in enumerate(keys(seed + 1, LANES + 1 + width)[LANES + 1 :]):
        np.multiply(h[k : k + n], factor, out=own)
        out += own
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Which windows of `width` words (by first word) lie in one text; `first` as from spans()."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for e in np.unique(first[1:]):  # a window that starts in the last width-1 words before a text's end crosses it
        ok[max(0, e - width + 1) : min(n, e)] = False
    return ok


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one per item) for each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Items that lie in a marked window of `width` items (marks by first item)."""
    delta = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    delta[at] += 1
    np.subtract.at(delta, np.minimum(at + width, n), 1)
    return np.cumsum(delta[:-1]) > 0


def text_of(item: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text (its number in the block) of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as numbers; data must have 8 bytes to spare at its end."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _differ(data: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of data (from `at`, n bytes) differ from those of `other` (from `begin`, size bytes). Both arrays have 8 bytes to spare."""
    out = n != size
    a, b, own, left = _lanes(data), _lanes(other), np.arange(len(n)), n
    for k in range(LANES + 1):
        if k == LANES:
            for i in own.tolist():
                out[i] |= not np.array_equal(data[at[i] : at[i] + n[i]], other[begin[i] : begin[i] + n[i]])
            break
        x = a[at[own] + 8 * k]
        x ^= b[begin[own] + 8 * k]
        x &= _FILLED[np.minimum(left, 8)]
        out[own] |= x != 0
        own = own[(left > 8) & ~out[own]]
        if not len(own):
            break
        left = n[own] - 8 * (k + 1)
    return out


class DistinctTable:
    """Values of distinct byte strings, kept over the blocks of a task; emptied beyond `limit` strings or `limit_bytes` of them.

    Strings are found by their hash, and their bytes are compared with those kept. A string that shares its hash with another
    one gets a value of its own. Keys are two sorted arrays (hash and slot). Subclasses say how values are stored.
    """

    def __init__(self, limit: int = 1_000_000, limit_bytes: int = 48 << 20):
        self.limit, self.limit_bytes = limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots, self.values, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0

    def extend(self, values) -> None:
        self.values.extend(values)

    def _add(self, raw: bytes, starts: list[int], ends: list[int], compute) -> np.ndarray:
        """Slots of new strings."""
        new = [raw[s:e] for s, e in zip(starts, ends)]
        self.extend(compute(new))
        size = np.fromiter(map(len, new), np.int64, len(new))
        total = int(size.sum())
        if self.filled + total + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.filled], np.zeros(self.filled + 2 * total + 64, np.uint8)])
        self.bytes[self.filled : self.filled + total] = np.frombuffer(b"".join(new), np.uint8)
        self.begin, self.size = np.append(self.begin, self.filled + np.cumsum(size) - size), np.append(self.size, size)
        self.filled += total
        self.used += len(new)
        return np.arange(self.used - len(new), self.used)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, compute) -> np.ndarray:
        """The slot of each span; compute(list of bytes) gives values for the spans not seen before."""
        if not len(starts):
            return np.zeros(0, np.int64)
        if self.used > self.limit or self.filled > self.limit_bytes:
            self.clear()
        h = span_hash(data, starts, ends)
        order = np.argsort(h)
        lead = np.concatenate([[True], np.diff(h[order]) != 0])
        number, at = np.cumsum(lead) - 1, order[lead]
        keys = h[at]
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        low = place < len(self.keys)
        known[low] = self.keys[place[low]] == keys[low]
        new, slot, raw = np.flatnonzero(~known), np.empty(len(keys), np.int64), data.tobytes()
        slot[known] = self.slots[place[known]]
        if len(new):
            slot[new] = self._add(raw, starts[at[new]].tolist(), ends[at[new]].tolist(), compute)
            self.keys, self.slots = np.insert(self.keys, place[new], keys[new]), np.insert(self.slots, place[new], slot[new])
        out = np.empty(len(h), np.int64)
        out[order] = slot[number]
        spare = np.concatenate([data, np.zeros(8, np.uint8)])
        odd = np.flatnonzero(_differ(spare, starts, ends - starts, self.bytes, self.begin[out], self.size[out]))
        if len(odd):  # spans whose hash another string has
            first = {raw[starts[i] : ends[i]]: i for i in odd.tolist()}
            own = self._add(raw, [starts[i] for i in first.values()], [ends[i] for i in first.values()], compute)
            at = dict(zip(first, own.tolist()))
            out[odd] = [at[raw[starts[i] : ends[i]]] for i in odd.tolist()]
        return out


class CountTable(DistinctTable):
    """A number for each string."""

    def clear(self) -> None:
        super().clear()
        self.values = np.zeros(0, np.int64)

    def extend(self, values) -> None:
        self.values = np.concatenate([self.values, np.asarray(values, np.int64)])


def gathered(flat: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of flat, each from its head on and of its length, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(heads - (ends - lengths), lengths)]


class RunTable(DistinctTable):
    """A run of numbers for each string; compute gives all numbers and the length of each run."""

    def clear(self) -> None:
        super().clear()
        self.lengths, self.heads, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def extend(self, values) -> None:
        flat, lengths = values
        self.heads = np.concatenate([self.heads, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the slots one after another, and the length of each."""
        lengths = self.lengths[slots]
        return gathered(self.flat, self.heads[slots], lengths), lengths


def cut(starts: np.ndarray, ends: np.ndarray, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans, cut in two at each point (sorted; points outside or at the start of spans do nothing)."""
    i = np.searchsorted(starts, points, "right") - 1
    ok = i >= 0
    ok[ok] = (starts[i[ok]] < points[ok]) & (points[ok] < ends[i[ok]])
    points, i = points[ok], i[ok]
    if not len(points):
        return starts, ends, first
    at = i + 1 + np.arange(len(points))
    new_starts, mask = np.empty(len(starts) + len(points), starts.dtype), np.zeros(len(starts) + len(points), bool)
    mask[at] = True
    new_starts[mask], new_starts[~mask] = points, starts
    new_ends = np.empty_like(new_starts)
    new_ends[:-1] = new_starts[1:]
    whole = np.concatenate([i[1:] != i[:-1], [True]])  # the last piece of a span that was cut ends where the span did
    new_ends[~mask] = ends
    new_ends[at - 1] = points
    new_ends[at[whole]] = ends[i[whole]]
    inner = at[~whole]
    new_ends[inner] = new_starts[inner + 1]
    return new_starts, new_ends, np.searchsorted(new_starts, np.append(starts, np.iinfo(np.int64).max)[first])


def units(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray, unsafe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text before every run of `mark` bytes, except where the byte before the run is `unsafe`.

    The units of a text join back to the whole text. Returned as spans() does.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    is_mark = mark[data]
    cut = np.zeros(n, bool)
    cut[1:] = is_mark[1:] & ~(is_mark | unsafe[data])[:-1]
    at = offsets[:-1]
    cut[at[at < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)

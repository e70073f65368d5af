"""Substring dedup by fixed-block anchors.

Method. A window is `width` consecutive words. Each text's non-overlapping blocks of (width + 1) / 2
words are the reference blocks: every window wholly holds one of its own text's blocks, and an equal
window elsewhere holds the same words at some place. So

1. every rolling block-length window probes the index of reference blocks; a block whose words begin at
   two or more places is a hit;
2. hits are extended: only windows that hold a hit block can repeat, and those are compared over all
   their words, by 96 bits of two independent hashes, which yields the maximal repeats. Among n windows two
   different ones are taken as equal with a chance of about n * n / 2**97: 10**-3 at 10**13 windows;
3. words covered by a repeating window go.

Scale. Probes and blocks meet in buckets of their hash, whose number follows the input's size. A task
first drops repeats of its own, so a bucket gets at most two entries for a window from each run of
`flush` words, however often a passage occurs. A probe travels as 4 bytes (the bucket is the rest of its
hash); a false match there only costs a comparison in step 2. No pairs are ever formed. Only buckets that hold
something are sent, and beyond 2**`COARSE` buckets entries are dealt out twice, first by their hash's first bits,
so a row sent never holds just a few entries and rows grow no faster than the input.

Rows are told apart by the Parquet file they lie in and their number there, which no scan changes. A table read
straight from Parquet files may be passed as `stored`; anything else is written first. Repeated rows (equal ids,
equal texts) are so many places. Null texts have no words. Texts under `width` words are kept whole. Long texts are
hashed block by block of about 2 MB, a longer text as one block.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.stage import file_place, settled
from flowquarry.llm.textcore import SPACE, covered, giving_back, inside, per_text, span_hash, text_blocks, text_of, window_hash, words

WIDTH = 35
BUCKET_BYTES = 4 << 20
FLUSH = 1_500_000
COARSE = 14

_U = np.uint64


def _by_place(chosen: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the chosen entries, in the order of their places."""
    found = np.flatnonzero(chosen)
    return found[np.lexsort((at[found], rows[found]))]


def _steps(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Each piece as differences between neighbours."""
    return [np.diff(r, prepend=0) for r in rows]


def _rows_of(batch: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(x.as_py() or b"", np.int64)) for x in batch.column(name)] or [np.zeros(0, np.int64)])


def _array(batch: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py() or b"", dtype) for x in batch.column(name)] or [np.zeros(0, dtype)])


def _blobs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


#: Sides of a packed row: arrays that start with a hash, and end with places (rows, at) or not; known places need no hash.
ANCHORS = (("probes",), ("blocks", "rows", "at"))
WINDOWS = (("h", "g", "rows", "at"), ("bare_h", "bare_g"))
KNOWN = ("known_rows", "known_at")
_KIND = {"g": np.uint32, "bare_g": np.uint32, "at": np.int32, "known_at": np.int32}


def _schema(sides: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join(["bucket int", *(f"{n} binary" for side in sides for n in side), *(f"{n} binary" for n in KNOWN)])


def _pack(sides: tuple, arrays: list[tuple], known: tuple, bits: int, suffix: bool) -> pa.RecordBatch:
    """A row for each bucket (the first `bits` of a hash) that holds something; known places are shared out over the rows.

    In a bucket, entries with places come in their order, so that differences are small. suffix: of a hash
    only the 32 bits after the bucket's are sent.
    """
    where, placed = [], []
    for side in arrays:
        w = (side[0] >> _U(64 - bits)).astype(np.int64)
        order = np.lexsort((side[-1], side[-2], w)) if len(side) > 2 else np.argsort(side[0], kind="stable")
        where.append(w[order])
        placed.append([x[order] for x in side])
    own = np.unique(np.concatenate(where))
    columns, names = [pa.array(own.astype(np.int32))], ["bucket"]
    for side, w, found in zip(sides, where, placed):
        cuts = list(zip(np.searchsorted(w, own).tolist(), np.searchsorted(w, own, "right").tolist()))
        if suffix:
            found[0] = (found[0] >> _U(32 - bits)).astype(np.uint32)
        for name, x in zip(side, found):
            pieces = [x[i:j] for i, j in cuts]
            columns.append(_blobs(_steps(pieces) if name == "rows" else pieces))
            names.append(name)
    n = max(1, len(own))
    columns += [_blobs(_steps(np.array_split(known[0], n))[: len(own)]), _blobs(np.array_split(known[1], n)[: len(own)])]
    return pa.record_batch(columns, names=[*names, *KNOWN])


def _unpack(batch: pa.Table, name: str, hashes: type = np.uint64) -> np.ndarray:
    return _rows_of(batch, name) if name.endswith("rows") else _array(batch, name, _KIND.get(name, hashes))


def _refine(sides: tuple, bits: int, suffix: bool, flush: int):
    """Rows of coarse buckets, sorted by bucket, to rows of the 2**bits buckets."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        return _pack(sides, [tuple(_unpack(rows, n) for n in side) for side in sides], tuple(_unpack(rows, n) for n in KNOWN), bits, suffix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if held and (n >= flush or held[0].column(0)[0] != row.column(0)[0]):
                    yield emit(held)
                    held, n = [], 0
                held.append(row)
                n += sum(len(row.column(side[0])[0].as_py()) for side in sides) // 8
        if held:
            yield emit(held)

    return run


def _dealt(rows: DataFrame, sides: tuple, bits: int, coarse: int, suffix: bool, flush: int) -> DataFrame:
    if bits <= coarse:
        return rows
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(giving_back(_refine(sides, bits, suffix, flush)), rows.schema)


def _repeated(sorted_keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys have an equal neighbour."""
    same = sorted_keys[1:] == sorted_keys[:-1]
    out = np.zeros(len(sorted_keys), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _anchors(width: int, bits: int, coarse: int, flush: int, seed: int):
    """Step 1, in tasks: probes and blocks of each bucket; blocks that repeat within the task as they are."""
    block = (width + 1) // 2

    def emit(h: list[np.ndarray], rows: list[np.ndarray], at: list[np.ndarray], is_block: list[np.ndarray]) -> pa.RecordBatch:
        h, rows, at, is_block = map(np.concatenate, (h, rows, at, is_block))
        order = np.argsort(h)
        h, rows, at, is_block = h[order], rows[order], at[order], is_block[order]
        again = _repeated(h)
        # of a repeated window two entries suffice: the first and the second of its run
        head = np.ones(len(h), bool)
        head[2:] = h[2:] != h[:-2]
        blocks, known = is_block & ~again, is_block & again
        known = _by_place(known, rows, at)
        return _pack(ANCHORS, [(h[head],), (h[blocks], rows[blocks], at[blocks])], (rows[known], at[known]), min(bits, coarse), bits <= coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], []), 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, data, offsets in text_blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                h = window_hash(span_hash(data, starts, ends, seed), block, seed)
                ok = inside(first, block)
                text = text_of(starts, first)[: len(h)]
                ok &= (np.diff(first) >= width)[text]
                pos = (np.arange(len(h)) - first[text])[ok]
                for part, x in zip(held, (h[ok], ids[a + text[ok]], (pos // block).astype(np.int32), pos % block == 0)):
                    part.append(x)
                n += len(pos)
                if n >= flush:
                    yield emit(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield emit(*held)

    return run


def _hits(group: pa.Table) -> pa.Table:
    """Step 1, in a bucket: blocks whose words begin at two places or more."""
    probes = np.sort(_array(group, "probes", np.uint32))
    twice = probes[1:][probes[1:] == probes[:-1]]
    blocks, rows, at = _array(group, "blocks", np.uint32), _rows_of(group, "rows"), _array(group, "at", np.int32)
    found = np.isin(blocks, twice)
    return pa.table(
        {"row": np.concatenate([rows[found], _rows_of(group, "known_rows")]), "at": np.concatenate([at[found], _array(group, "known_at", np.int32)])}
    )


def _candidates(width: int, bits: int, coarse: int, flush: int, seeds: tuple[int, int]):
    """Step 2, in tasks: windows that hold a hit block, with two hashes of all their words."""
    block = (width + 1) // 2

    def emit(held: tuple) -> pa.RecordBatch:
        h, g, rows, at = map(np.concatenate, held)
        order = np.lexsort((g, h))
        h, g, rows, at = h[order], g[order], rows[order], at[order]
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        second = np.zeros(len(h), bool)  # of a run of repeats, the first two go on, for other tasks' windows
        second[1:] = same
        head = ~second
        head[1:] |= second[1:] & head[:-1]
        named, bare = ~again, again & head
        again = _by_place(again, rows, at)
        return _pack(WINDOWS, [(h[named], g[named], rows[named], at[named]), (h[bare], g[bare])], (rows[again], at[again]), min(bits, coarse), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], []), 0
        for batch in batches:
            ids, hits = batch.column(0).to_numpy(), batch.column(2)
            bounds = hits.offsets.to_numpy()
            flat = hits.values.to_numpy()
            for a, b, data, offsets in text_blocks(batch.column(1)):
                starts, ends, first = words(data, offsets)
                total = len(starts)
                heads = np.repeat(first[:-1], np.diff(bounds[a : b + 1])) + flat[bounds[a] : bounds[b]].astype(np.int64) * block
                # windows that hold words head .. head + block - 1
                delta = np.zeros(total + 2, np.int32)
                np.add.at(delta, np.maximum(heads - (width - block), 0), 1)
                np.subtract.at(delta, heads + 1, 1)
                ok = inside(first, width)
                ok &= np.cumsum(delta)[: len(ok)] > 0
                at = np.flatnonzero(ok)
                text = text_of(starts, first)[at]
                h, g = (window_hash(span_hash(data, starts, ends, seed), width, seed)[at] for seed in seeds)
                for part, x in zip(held, (h, g.astype(np.uint32), ids[a + text], (at - first[text]).astype(np.int32))):
                    part.append(x)
                n += len(at)
                if n >= flush:
                    yield emit(held)
                    held, n = ([], [], [], []), 0
        if n:
            yield emit(held)

    return run


def _repeats(group: pa.Table) -> pa.Table:
    """Step 2, in a bucket: windows that start at two places or more."""
    named = _array(group, "h", np.uint64)
    h, g = np.concatenate([named, _array(group, "bare_h", np.uint64)]), np.concatenate([_array(group, "g", np.uint32), _array(group, "bare_g", np.uint32)])
    order = np.lexsort((g, h))
    same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again = again[: len(named)]
    rows, at = _rows_of(group, "rows"), _array(group, "at", np.int32)
    return pa.table(
        {"row": np.concatenate([rows[again], _rows_of(group, "known_rows")]), "at": np.concatenate([at[again], _array(group, "known_at", np.int32)])}
    )


def _strip(width: int, names: list[str]):
    """Step 3: the words that no repeating window covers, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            bounds, flat = hits.offsets.to_numpy(), hits.values.to_numpy()
            for a, b, data, offsets in text_blocks(batch.column(1)):
                data = np.insert(data, offsets[1:], 32)  # so that every word is followed by a separator of its own text
                offsets = offsets + np.arange(len(offsets))
                starts, ends, first = words(data, offsets)
                n = len(starts)
                marks = np.zeros(n, bool)
                marks[np.repeat(first[:-1], np.diff(bounds[a : b + 1])) + flat[bounds[a] : bounds[b]]] = True
                kept = ~covered(marks, width, n) if marks.any() else np.ones(n, bool)
                removed = per_text(~kept, first)
                k = np.flatnonzero(kept)
                text = text_of(starts, first)[k]
                stop = ends[k] + 1
                last = np.ones(len(k), bool)
                last[:-1] = text[1:] != text[:-1]
                stop[last] -= 1
                delta = np.zeros(len(data) + 1, np.int8)
                delta[starts[k]] = 1
                delta[stop] -= 1
                take = np.cumsum(delta[:-1], dtype=np.int8) > 0
                out = np.where(SPACE[data], np.uint8(32), data)[take]
                lengths = np.bincount(text, stop - starts[k], len(offsets) - 1).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                texts = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.tobytes()), pa.py_buffer(out.tobytes()))
                counts = np.diff(first)
                own = [batch.column(3 + i).slice(a, b - a) for i in range(len(names))]
                yield pa.record_batch([*own, texts, pa.array(counts), pa.array(removed)], names=[*names, "kept_text", "n_words", "n_removed"])

    return run


def substring_dedup(
    docs: DataFrame, width: int = WIDTH, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, flush: int = FLUSH, keep: tuple[str, ...] = ("doc_id",), stored: bool = False, coarse: int = COARSE
) -> DataFrame:
    """Per row: the `keep` columns, kept_text, n_words and n_removed. `width` must be odd and at least 3.

    stored: docs is read straight from Parquet files. bucket_bytes: of those files, for each bucket.
    """
    names = [f"_keep_{i}" for i in range(len(keep))]
    columns = [docs[text_col].cast("string").alias("_text"), *[docs[c].alias(n) for c, n in zip(keep, names)]]
    if not stored:
        docs = settled(docs.select(*columns))
        columns = [docs[c] for c in ("_text", *names)]
    place, size = file_place(docs)
    bits = max(4, int(size // bucket_bytes).bit_length())
    seeds = secrets.randbits(60), secrets.randbits(60)
    # both joins below read the same columns, so that Spark deals the texts out once
    base = docs.select(place.alias("_row"), *columns)
    index = base.select("_row", "_text").mapInArrow(giving_back(_anchors(width, bits, coarse, flush, seeds[0])), _schema(ANCHORS))
    index = _dealt(index, ANCHORS, bits, coarse, True, flush)
    hits = index.groupBy("bucket").applyInArrow(_hits, "row long, at int").groupBy("row").agg(F.collect_list("at").alias("_hits"))
    near = base.join(hits, base["_row"] == hits["row"]).select("_row", "_text", "_hits", *names)
    windows = near.mapInArrow(giving_back(_candidates(width, bits, coarse, flush, seeds)), _schema(WINDOWS))
    windows = _dealt(windows, WINDOWS, bits, coarse, False, flush)
    repeats = windows.groupBy("bucket").applyInArrow(_repeats, "row long, at int").groupBy("row").agg(F.collect_list("at").alias("_repeats"))
    none = F.array().cast("array<int>")
    both = base.join(repeats, base["_row"] == repeats["row"], "left").select("_row", "_text", F.coalesce("_repeats", none).alias("_repeats"), *names)
    schema = T.StructType([base.schema[n] for n in names]).add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    out = both.mapInArrow(giving_back(_strip(width, names)), schema)
    return out.toDF(*keep, "kept_text", "n_words", "n_removed")

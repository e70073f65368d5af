"""SimHash near-dedup with a byte-position inverted index and count filtering.

Method. A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most 4 bits differ in at
most 4 bytes, so the guaranteed minimum is 4 shared positional bytes. Any pair with 4 of 8 shared shares at least s
of any 4 + s positions, so posting lists of s positional bytes, over 4 + s positions, hold every such pair; s follows
the number of fingerprints, so that lists of unlike fingerprints stay short at any size (`list_length`). In a list
each pair's shared positional bytes are tallied, pairs under the minimum go, and the rest are verified by their bits.

Scale. Only distinct fingerprints are indexed: any number of copies is one posting, and classes are put
back on documents at the end. A list up to `block` fingerprints is searched where it lies. A longer one is written as
blocks while it streams by, and Spark joins pairs of blocks and deals them out, so no task holds such a list and a
pair's work is bounded. Pairs are never written: a search gives at most one link per fingerprint (a spanning
forest of what it links). Components are found by contraction in Spark.

Null texts and texts without words have fingerprint zero and are linked like any other. Null ids are
ignored in the smallest id of a component (null if it has no other). Repeated rows are one class. Long texts are
hashed in bounded runs of shingles. Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.graph import components
from flowquarry.llm.stage import settled
from flowquarry.llm.textcore import LOWER, SPACE, giving_back, text_blocks, text_of, words

SHINGLE = 4
MAX_BITS = 4
BLOCK, LIST_LENGTH = 1 << 14, 64
#: Fixed value: the seed of the shingle hash.
SEED = 42

_U = np.uint64


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts with one blank after each, and where they lie there."""
    data = np.insert(LOWER[data], offsets[1:], 32)
    offsets = offsets + np.arange(len(offsets))
    starts, ends, first = words(data, offsets)
    take = np.zeros(len(data) + 1, np.int8)
    take[starts] = 1
    take[ends + 1] -= 1
    take = np.cumsum(take[:-1], dtype=np.int8) > 0
    out = np.where(SPACE[data], np.uint8(32), data)[take]
    lengths = ends - starts
    heads = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    return out.tobytes(), heads, heads + lengths, first


def fingerprint_block(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    import xxhash

    raw, starts, ends, first = _joined(data, offsets)
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(count)), shingles)
    lead = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][text]
    tail = np.minimum(lead + shingle - 1, first[1:][text] - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(starts[lead].tolist(), ends[tail].tolist())), np.uint64, len(text))
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        heads = (np.cumsum(shingles) - shingles)[full]
        for a, b, x, y in _runs(full, heads, len(h)):
            bits = np.unpackbits(h[x:y].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, heads[a:b] - x, axis=0, dtype=np.int32)
            over = 2 * sums > shingles[full[a:b], None]
            out[full[a:b]] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def _runs(full: np.ndarray, heads: np.ndarray, total: int, limit: int = 1 << 17):
    """Runs of texts with about `limit` shingles, so that the bit matrix stays small."""
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(heads, heads[a] + limit, "right")) - 1)
        b = min(b, len(full))
        yield a, b, int(heads[a]), int(heads[b]) if b < len(full) else total
        a = b


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """Per row: row (its place; by default its number in this run, so write the result before using it twice), id, and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_block(data, offsets, shingle) for _, _, data, offsets in text_blocks(batch.column(2))]
            if fps:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(fps).view(np.int64))], names=["row", "id", "fp"])

    place = F.monotonically_increasing_id() if place is None else place
    rows = docs.select(place.alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].cast("string"))
    return rows.mapInArrow(giving_back(run), "row long, id long, fp long")


def lists_of(n: int, max_bits: int, list_length: int = LIST_LENGTH) -> list[tuple[int, ...]]:
    """The sets of positions that posting lists are kept on, for n fingerprints."""
    least = 8 - max_bits
    if least < 1:
        raise ValueError("more than 7 bits guarantee no shared byte")
    s = next((s for s in range(1, least) if n <= list_length << (8 * s)), least)
    return list(itertools.combinations(range(max_bits + s), s))


def _postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """One row per posting of each fingerprint: the list (its set's number and the bytes there) and fp."""
    masks = [sum(0xFF << (8 * p) for p in own) for own in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.set", "k.bytes", "fp")


def _agree(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which xors come from linked pairs: enough shared positional bytes, then few enough bits."""
    y = x | x >> _U(4)
    y |= y >> _U(2)
    y |= y >> _U(1)
    shared = 8 - np.bitwise_count(y & _U(0x0101010101010101))
    return (shared >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of the linked members a[i], b[i], in place; a label is its group's least member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label == label[label]).all():
            label[:] = label[label]


def _forest(fps: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _short(fps: np.ndarray, heads: np.ndarray, ends: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many short lists at once: each fingerprint meets the k-th after it in its list, for every k."""
    end_of = np.zeros(len(fps), np.int64)
    end_of[heads] = ends
    end_of = np.maximum.accumulate(end_of)
    label, at, k = np.arange(len(fps)), np.arange(len(fps)), 1
    while len(at := at[at + k < end_of[at]]):
        ok = _agree(fps[at] ^ fps[at + k], max_bits)
        _merge(label, at[ok], at[ok] + k)
        k += 1
    return _forest(fps, label)


def _long(x: np.ndarray, y: np.ndarray, max_bits: int, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of x and of y, which may be the same block."""
    fps, off = (x, 0) if np.array_equal(x, y) else (np.concatenate([x, y]), len(x))
    n = len(fps)
    label = np.arange(n)
    for i in range(0, len(x), tile):
        j = min(i + tile, len(x))
        near = _agree(x[i:j, None] ^ y[None, :], max_bits)
        groups = label[off:]
        low, high = np.where(near, groups, n).min(axis=1), np.where(near, groups, -1).max(axis=1)
        for r in np.flatnonzero((high >= 0) & ((low != high) | (low != label[i:j]))).tolist():
            found = np.flatnonzero(near[r]) + off
            found = found[np.unique(label[found], return_index=True)[1]]  # one of each group suffices
            _merge(label, np.full(len(found), i + r), found)
        if not label.any():  # all are one group
            break
    return _forest(fps, label)


def _search(max_bits: int, block: int, short: int = 64):
    """Sorted postings to links (part -1: a and b) and to blocks of long lists (part: number in the list, a: its fingerprints)."""

    def links(heads: np.ndarray, ends: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
        size = ends - heads
        few = size <= short
        if few.any():
            own = np.cumsum(size[few])
            at = np.arange(own[-1]) + np.repeat(heads[few] - (own - size[few]), size[few])
            yield (0, 0, -1, *_short(fps[at], own - size[few], own, max_bits))
        for s, e in zip(heads[~few].tolist(), ends[~few].tolist()):
            yield (0, 0, -1, *_long(fps[s:e], fps[s:e], max_bits))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32())
        return pa.record_batch(
            [*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (3, 4))],
            names=["set", "bytes", "part", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, none = [np.zeros(0, np.int64)] * 3, 0, np.zeros(0, np.uint64)  # parts: blocks written of the list that held begins with
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = (batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy())
                held = [np.concatenate([h, x]) for h, x in zip(held, own)]
            if not len(held[0]):
                continue
            edge = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            heads, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(held[0])]])
            fps, out = held[2].view(np.uint64), []
            whole = np.ones(len(heads), bool)
            for k in np.unique([*np.flatnonzero(ends - heads > block).tolist(), *([0] if parts else [])]).astype(int).tolist():
                whole[k] = False
                at, last = int(heads[k]), batch is not None and k == len(heads) - 1
                number = parts if k == 0 else 0
                while at < ends[k] and (not last or ends[k] - at > block):
                    out.append((int(held[0][at]), int(held[1][at]), number, fps[at : min(at + block, int(ends[k]))], none))
                    at, number = at + block, number + 1
                if last:
                    heads[k], parts = min(at, int(ends[k])), number
            if batch is not None:  # the last list may go on in the next batch
                if whole[-1]:
                    parts = 0
                cut, whole[-1] = int(heads[-1]), False
            else:
                cut = len(fps)
            if whole.any():
                out += links(heads[whole], ends[whole], fps)
            held = [h[cut:] for h in held]
            if out:
                yield table(out)

    return run


def _pairs_of_blocks(max_bits: int):
    """Links in each pair of blocks (a, b: their fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                x, y = _long(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), max_bits)
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["src", "dst"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            yield pa.record_batch([pa.array(np.frombuffer(a.as_py(), np.int64)), pa.array(np.frombuffer(b.as_py(), np.int64))], names=["src", "dst"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, list_length: int = LIST_LENGTH) -> DataFrame:
    """(src, dst) over the distinct fingerprints in fps (fp: long; read twice), enough to join all that differ in at most max_bits bits."""
    postings = _postings(fps, lists_of(fps.count(), max_bits, list_length))
    dealt = postings.repartition("set", "bytes").sortWithinPartitions("set", "bytes", "fp")
    found = settled(dealt.mapInArrow(giving_back(_search(max_bits, block)), "set int, bytes long, part int, a binary, b binary"))
    out = found.where("part < 0").select("a", "b").mapInArrow(_unpack, "src long, dst long")
    blocks = found.where("part >= 0").select("set", "bytes", "part", "a")
    if blocks.isEmpty():
        return out
    last = blocks.groupBy("set", "bytes").agg(F.max("part").alias("last"))
    pairs = blocks.select("set", "bytes", "part").join(last, ["set", "bytes"]).select("set", "bytes", "part", F.explode(F.sequence("part", "last")).alias("other"))
    pairs = pairs.join(blocks, ["set", "bytes", "part"]).join(blocks.toDF("set", "bytes", "other", "b"), ["set", "bytes", "other"])
    spread = pairs.repartition(F.xxhash64("set", "bytes", "part", "other")).select("a", "b")
    return out.union(spread.mapInArrow(giving_back(_pairs_of_blocks(max_bits)), "src long, dst long"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None
) -> DataFrame:
    """Per row: row, id, fp, component_id (smallest id reachable) and keeper (the row that stands for the component).

    row is `place`, a column of docs that tells rows apart; by default a number that only this result knows.
    """
    rows = settled(fingerprints(docs, shingle, id_col, text_col, place))
    # nulls last, so that a row with an id stands for its group if there is one
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("least")
    classes = settled(rows.groupBy("fp").agg(least))
    found = components(links(classes.select("fp"), max_bits))
    placed = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the join below deals out both sides anew and Spark can split a component's many fingerprints
    best = settled(placed.groupBy("root").agg(F.min("least").alias("best")).withColumnRenamed("root", "_root"))
    by_fp = placed.join(best, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "best")
    return rows.join(by_fp, F.col("fp") == F.col("_fp")).select(
        "row", "id", "fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("keeper")
    )


def hex_fingerprint(column):
    """A signed long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")

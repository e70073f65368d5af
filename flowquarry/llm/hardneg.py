"""Hard-negative mining by rotated one-bit codes and exact integer scores.

Method. Components become whole numbers, and a vector o is rotated by one random rotation for all. Its code is the signs
of the rotated components, a unit vector s; stored beside it are the alignment a = <s, o> and the length of the rest r = o - a s.
An anchor q is rotated too and written in `PLANES` bit planes. Popcounts of code and planes give c' near c = <s, q>,
off by at most the length of what the planes leave out. As r stands at a right angle to s,

    <o, q> = a c + <r, q>    and    |<r, q>| <= |r| * sqrt(|q|^2 - c^2)    (Cauchy-Schwarz),

which is an interval that holds the score for certain. A row goes if its interval's upper end lies under the k-th best lower
end or exact score known, or if the interval misses every window that is asked for; all others are scored in whole numbers.

Scale. Anchors are a stated query set: in blocks they meet blocks of rows by an equi-join on two block numbers. Both sides
are dealt by a hash of their place in a written table, so no label, id or vector is a hot key. A pair of blocks gives at most k
rows an anchor (and positive), and a window takes the best. Nothing is collected.

Cases. Rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part; vectors of
different lengths are an error. Zero vectors take part. Rows that share an anchor's id are the anchor itself; an anchor that
is there again with the same label and vector counts once, with another one it is an anchor of its own. Equal scores are ordered by id, and
repeated negatives are rows of their own. A window of a negative positive score is empty. An empty table gives no rows. Scores
beyond 64 bits are an error. Extra columns take no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.stage import file_place, settled

POSITIVES, NEGATIVES, FACTOR, PLANES = 5, 10, 256.0, 6
#: A negative's score, in hundredths of the positive's.
LEAST, MOST = 30, 90
#: Components of vectors in a block of rows and of anchors, and anchors met at once.
ROW_NUMBERS, ANCHOR_NUMBERS, AT_ONCE = 1 << 20, 1 << 17, 32
SEED = 7


@functools.lru_cache(2)
def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))[0]


def whole_numbers(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(FACTOR * flat).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rotated(v: np.ndarray) -> np.ndarray:
    size = -(-v.shape[1] // 64) * 64
    return np.pad(v, ((0, 0), (0, size - v.shape[1]))) @ rotation(size)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64 signs a word), alignments and the lengths of the rests."""
    turned = rotated(v)
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    rest = np.sqrt(np.maximum(0.0, (turned * turned).sum(axis=1) - align * align))
    return np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64), align, rest


class Planes:
    """Anchors in bit planes."""

    def __init__(self, v: np.ndarray):
        turned = rotated(v)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        kept = self.low[:, None] + self.step[:, None] * level
        self.total, self.off, self.square = kept.sum(axis=1), np.linalg.norm(turned - kept, axis=1), (turned * turned).sum(axis=1)
        self.bits = [np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        self.size = turned.shape[1]

    def bounds(self, at: slice, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which values the scores of these anchors and all codes lie."""
        ones, tally = np.bitwise_count(code).sum(axis=1, dtype=np.int64), np.zeros((self.low[at].size, len(code)))
        for j, plane in enumerate(self.bits):
            for k in range(code.shape[1]):
                tally += np.bitwise_count(plane[at, k, None] & code[None, :, k]) * float(1 << j)
        near = (2 * (self.low[at, None] * ones + self.step[at, None] * tally) - self.total[at, None]) / np.sqrt(self.size)
        off, square = self.off[at, None], self.square[at, None]
        least = np.maximum(0.0, np.abs(near) - off)
        wide = align * off + rest * np.sqrt(np.maximum(0.0, square - least * least))
        wide += 1e-9 * np.sqrt(square) * (align + rest) + 1e-6  # what rounding can take away
        return align * near - wide, align * near + wide


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one anchor with rows of whole numbers, exactly."""
    if not len(rows):
        return np.zeros(0, np.int64)
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ anchors).astype(np.int64)
    own = [int(x) for x in anchors]
    return np.array([sum(int(x) * y for x, y in zip(r, own)) for r in rows], np.int64)


def usable(table: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    rows = table.select(table[id_col].cast("long").alias("id"), label.cast("long").alias("label"), table[vec_col].alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return rows.where("id is not null and label is not null and size(vec) > 0").where(F.forall("vec", fine))


_CODED = "id long, label long, whole binary, code binary, align double, rest double"


def _encode(batches):
    for batch in batches:
        if batch.num_rows:
            v = whole_numbers(batch.column("vec"))
            code, align, rest = coded(v)
            columns = [batch.column("id"), batch.column("label"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(align), pa.array(rest)]
            yield pa.record_batch(columns, names=["id", "label", "whole", "code", "align", "rest"])


def _numbers(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Side:
    """A block of coded rows."""

    def __init__(self, table: pa.Table):
        self.id, self.label = table["id"].to_numpy(), table["label"].to_numpy()
        self.v = _numbers(table["whole"])
        if "code" in table.column_names:
            self.code, self.align, self.rest = _numbers(table["code"], np.uint64), table["align"].to_numpy(), table["rest"].to_numpy()


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties by id."""
    return np.lexsort((ids, -score))[:k]


def _positives(k: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "other": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            a, r, keys = Side(anchors), Side(rows), anchors["anchor"].to_pylist()
            planes = Planes(a.v)
            for x in range(0, len(keys), AT_ONCE):
                low, high = planes.bounds(slice(x, x + AT_ONCE), r.code, r.align, r.rest)
                for i, own_low, own_high in zip(range(x, len(keys)), low, high):
                    at = np.flatnonzero((r.label == a.label[i]) & (r.id != a.id[i]))
                    if len(at) > k:
                        least = np.partition(own_low[at], len(at) - k)[len(at) - k]
                        at = at[own_high[at] >= least]
                    found = scores(a.v[i], r.v[at])
                    best = _first(found, r.id[at], k)
                    out["anchor"] += [keys[i]] * len(best)
                    out["other"] += r.id[at][best].tolist()
                    out["score"] += found[best].tolist()
        return pa.table({"anchor": pa.array(out["anchor"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return meet


def _negatives(k: int, least: int, most: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "slot": [], "other": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            a, r, keys = Side(anchors), Side(rows), anchors["anchor"].to_pylist()
            asked, planes = anchors["positive_scores"].to_pylist(), Planes(a.v)
            for x in range(0, len(keys), AT_ONCE):
                low, high = planes.bounds(slice(x, x + AT_ONCE), r.code, r.align, r.rest)
                for i, own_low, own_high in zip(range(x, len(keys)), low, high):
                    other = r.label != a.label[i]
                    windows = [(-(-least * p // 100), most * p // 100) for p in asked[i]]
                    near = np.zeros(len(other), bool)
                    for first, last in windows:
                        hit = other & (own_high >= first) & (own_low <= last)
                        sure = own_low[hit & (own_low >= first) & (own_high <= last)]
                        if len(sure) > k:  # so many lie in the window for certain: the k-th of them is a bar
                            hit &= own_high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                        near |= hit
                    at = np.flatnonzero(near)
                    found = scores(a.v[i], r.v[at])
                    order = np.lexsort((r.id[at], -found))
                    ids, found = r.id[at][order], found[order]
                    for slot, (first, last) in enumerate(windows):
                        start = int(np.searchsorted(-found, -last))
                        stop = min(start + k, int(np.searchsorted(-found, -first, "right")))
                        if stop > start:
                            out["anchor"] += [keys[i]] * (stop - start)
                            out["slot"] += [slot] * (stop - start)
                            out["other"] += ids[start:stop].tolist()
                            out["score"] += found[start:stop].tolist()
        return pa.table({"anchor": pa.array(out["anchor"], pa.int64()), "slot": pa.array(out["slot"], pa.int32()), "other": pa.array(out["other"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return meet


def _met(anchors: DataFrame, rows: DataFrame, numbers: tuple[int, int], function, schema: str) -> DataFrame:
    """function over each pair of a block of anchors and a block of rows. numbers: the components of all anchors and of all rows."""
    a, r = -(-numbers[0] // ANCHOR_NUMBERS) or 1, -(-numbers[1] // ROW_NUMBERS) or 1
    left = anchors.withColumn("_a", F.pmod(F.xxhash64("anchor"), F.lit(a))).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))))
    right = rows.withColumn("_r", F.pmod(F.xxhash64("place"), F.lit(r))).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))))
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(function, schema)


def hard_negatives(
    table: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). label: over table's columns; is_anchor: over the column id.

    An anchor's positives are the `positives` best other rows of its label; for each, the best `negatives` rows of another label follow whose
    score is `least` to `most` hundredths of the positive's.
    """
    rows = usable(table, label, id_col, vec_col)
    size = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.count("*").alias("n")).first()
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} and of {size['most']} components")
    stored = settled(rows.mapInArrow(_encode, _CODED))
    place, _ = file_place(stored)
    rows = stored.withColumn("place", place)
    anchors = stored.where(is_anchor).select("id", "label", "whole").distinct()
    anchors = settled(anchors.withColumn("anchor", F.xxhash64("id", "label", "whole")))
    numbers = tuple(n * (size["most"] or 1) for n in (anchors.count(), size["n"]))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    met = _met(anchors, rows, numbers, _positives(positives), "anchor long, other long, score long")
    found = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "other", "score"))).alias("p"))  # at most `positives` a list
    known = settled(anchors.join(lists, "anchor").select("anchor", "id", "label", "whole", F.col("p.other").alias("positive_ids"), F.col("p.score").alias("positive_scores")))
    met = _met(known, rows, numbers, _negatives(negatives, least, most), "anchor long, slot int, other long, score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    taken = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = taken.join(known.select("anchor", "id", "positive_ids", "positive_scores"), "anchor")
    at = lambda c: F.get(c, F.col("slot"))
    return named.select(
        F.col("id").alias("anchor_id"), at("positive_ids").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        at("positive_scores").alias("positive_score"), F.col("score").alias("negative_score"),
    )

"""Quality rules: base rules on the text, then a hashed n-gram log-likelihood ratio.

Method. Words and word pairs are hashed into `BUCKETS` buckets; the size of what the driver and the tasks hold is thus fixed. Two multinomials are counted: the raw corpus over every document, and the trusted target
over every document that the labels call good. A document's score is the mean over its n-grams of
log p_target - log p_raw, so its length plays no part. A document is kept if its score is at least the threshold,
which is the same for all and comes from the scores of labelled documents: the point that separates the two label
classes best, where rejecting a good document counts `GOOD_WEIGHT` times as much as keeping a bad one. A trusted
document's score is taken without its own counts there, so that the threshold holds for documents without a label.

Bounds. Nothing is sampled: both multinomials cover every document that belongs to them, and the threshold is fitted on every
labelled one. The ids of up to `SENT_IDS` good labels are sent to the tasks; more of them are joined, with the same counts.
Each task adds its counts up before they are shuffled. For the threshold every document is scored, and its scores' bins, not its
text, meet the labels in a join. The driver receives one sum a bucket and a histogram of `BINS` bins. A very long text is one
block of its own. Extra columns come back as `in_` and their name.

Lines and windows of a text are compared by 64-bit hashes: two different ones count as equal with a chance of 2**-64 a pair.
An empty table gives no rows.

Nulls: a null text has no words, fails the base rules and is not kept. Labels with a null id or quality are ignored. With
no trusted document the scores are zero and the base rules decide alone; with no counter-examples the
threshold is minus infinity. Repeated rows are each judged by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.textcore import SPACE, byte_table, covered, giving_back, inside, mix, per_text, span_hash, spans, text_blocks, text_of, window_hash, words

BUCKETS = 1 << 16
SENT_IDS = 1_000_000
SMOOTHING = 0.05
BINS = 4096
LOW, HIGH = -8.0, 8.0
GOOD_WEIGHT = 5.0
#: Fixed values of the base rules.
SYMBOLS = byte_table(b"#*$%&|<>")
MIN_WORDS, REPEAT_WIDTH, MAX_REPEAT_PERCENT = 10, 5, 20

_U = np.uint64


class Block:
    """What a block of texts holds: words and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = words(data, offsets)
        self.h = span_hash(data, self.starts, self.ends)
        self.n_words = np.diff(self.first)

    def ngrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words and pairs, and the text of each."""
        shift = _U(64 - (buckets - 1).bit_length())
        text = text_of(self.starts, self.first)
        ok = inside(self.first, 2)
        pair = window_hash(self.h, 2)[ok]
        return np.concatenate([self.h >> shift, pair >> shift]).astype(np.int64), np.concatenate([text, text[: len(ok)][ok]])


def _by_bytes(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur at least twice, and which are not the first of their kind."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets, first = block.data, block.offsets, block.first
    salt = lambda text: mix(text.astype(np.uint64) + _U(1))
    lead = (data & 0xC0) != 0x80
    line_start, line_end, line_first = spans(data != 10, offsets)  # empty lines have no word and need no place
    at = np.searchsorted(block.starts, line_start)
    worded = at < np.searchsorted(block.starts, line_end)
    line_start, line_end, line_text = line_start[worded], line_end[worded], text_of(line_start, line_first)[worded]
    _, later = _seen_before(span_hash(data, line_start, line_end) ^ salt(line_text))
    ok = inside(first, REPEAT_WIDTH)
    win = window_hash(block.h, REPEAT_WIDTH)
    at = np.flatnonzero(ok)
    twice, _ = _seen_before(win[at] ^ salt(text_of(block.starts, first)[at]))
    marks = np.zeros(len(block.starts), bool)
    marks[at[twice]] = True
    return {
        "n_words": block.n_words,
        "word_chars": _by_bytes(lead & ~SPACE[data], offsets),
        "n_symbols": _by_bytes(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_text[later], minlength=len(block.n_words)).astype(np.int64),
        "n_repeat_words": per_text(covered(marks, REPEAT_WIDTH, len(marks)), first) if marks.any() else np.zeros(len(block.n_words), np.int64),
    }


def labelled(labels: DataFrame, quality: int) -> DataFrame:
    """(doc_id) of the distinct ids with this label."""
    own = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull())
    return own.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _flags(batch: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    column = batch.column(0)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return known & np.isin(column.fill_null(0).to_numpy(), ids)


def _add(sums: np.ndarray, at: np.ndarray) -> None:
    if len(at) > len(sums) // 4:
        sums += np.bincount(at, minlength=len(sums))
    else:
        own, n = np.unique(at, return_counts=True)
        sums[own] += n


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, sent_ids: int = SENT_IDS) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all texts, and in trusted ones."""
    spark, rows, ids = docs.sparkSession, _rows(docs), None
    if trusted.count() <= sent_ids:
        ids = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in trusted.collect()), np.int64))  # at most sent_ids
    else:
        rows = rows.join(trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("good")), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.coalesce("good", F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = _flags(batch, ids.value) if ids is not None else batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_blocks(batch.column(1)):
                grams, text = Block(data, offsets).ngrams(buckets)
                _add(raw, grams)
                _add(target, grams[good[a:b][text]])
        own = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(own), pa.array(raw[own]), pa.array(target[own])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(giving_back(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    found = sums.toArrow()  # one row a bucket at most
    raw[found["bucket"].to_numpy()], target[found["bucket"].to_numpy()] = found["raw"].to_numpy(), found["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros if there is no trusted text."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))
    return share(target) - share(raw)


def block_scores(block: Block, weights: np.ndarray) -> np.ndarray:
    grams, text = block.ngrams(len(weights))
    n = np.bincount(text, minlength=len(block.n_words))
    return np.bincount(text, weights[grams], len(block.n_words)) / np.maximum(n, 1)


def left_out_scores(block: Block, weights: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The scores as they would be, had each text's own n-grams not been counted in the target; of use for trusted texts alone."""
    grams, text = block.ngrams(len(weights))
    n = np.bincount(text, minlength=len(block.n_words))
    _, back, own = np.unique(text * len(weights) + grams, return_inverse=True, return_counts=True)
    # texts that are not trusted may have more of an n-gram, or more n-grams, than the target
    part = weights[grams] + np.log((np.maximum(target[grams] - own[back], 0) + SMOOTHING) / (target[grams] + SMOOTHING))
    room, total = SMOOTHING * len(weights), target.sum()
    return np.bincount(text, part, len(n)) / np.maximum(n, 1) - np.log((np.maximum(total - n, 0) + room) / (total + room))


def score_bins(docs: DataFrame, weights: np.ndarray, target: np.ndarray) -> DataFrame:
    """(doc_id, bad, good) of each row with words: the bins of its score, as a text that the target has not seen and as a trusted one."""
    w = docs.sparkSession.sparkContext.broadcast((weights, target))
    width = (HIGH - LOW) / BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                block = Block(data, offsets)
                at = np.flatnonzero(block.n_words)
                bins = [np.clip((x[at] - LOW) / width, 0, BINS - 1).astype(np.int32) for x in (block_scores(block, w.value[0]), left_out_scores(block, *w.value))]
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(at)), *map(pa.array, bins)], names=["doc_id", "bad", "good"])

    return _rows(docs).where("doc_id is not null").mapInArrow(giving_back(count), "doc_id long, bad int, good int")


def fit_threshold(docs: DataFrame, labels: DataFrame, weights: np.ndarray, target: np.ndarray) -> float:
    """The score that separates the labelled classes best; minus infinity if a class is missing.

    Trusted texts are scored without their own counts, as texts that the target has not seen are.
    """
    if not weights.any():
        return -math.inf
    classes = labelled(labels, 0).withColumn("is_good", F.lit(False)).union(labelled(labels, 1).withColumn("is_good", F.lit(True)))
    own = score_bins(docs, weights, target).join(classes, "doc_id")
    sums = own.groupBy("is_good", F.when(F.col("is_good"), F.col("good")).otherwise(F.col("bad")).alias("bin")).count()
    hist = np.zeros((2, BINS + 1))
    for good, at, n in sums.collect():  # at most 2 * BINS rows
        hist[int(good), at + 1] = n
    if not hist[0].sum() or not hist[1].sum():
        return -math.inf
    below = np.cumsum(hist, axis=1) / hist.sum(axis=1, keepdims=True)
    gain = below[0] - GOOD_WEIGHT * below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return LOW + (HIGH - LOW) / BINS * float(best[0] + best[-1]) / 2  # the middle of the best stretch, away from both classes


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sent_ids: int = SENT_IDS) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, score and threshold, in the order of docs' rows within a task."""
    good = labelled(labels, 1)
    raw, target = ngram_counts(docs, good, buckets, sent_ids)
    weights = log_ratios(raw, target)
    threshold = fit_threshold(docs, labels, weights, target)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c].alias(f"_x{i}") for i, c in enumerate(extra)]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                block = Block(data, offsets)
                counts = base_counts(block)
                score = block_scores(block, shared.value)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                out = [*(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns, *out], names=[*own.schema.names, *names, "base_failed", "kept", "score"])

    schema = T.StructType(list(rows.schema.fields))
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("score", "double")
    found = rows.mapInArrow(giving_back(judge), schema)
    return found.withColumn("threshold", F.lit(threshold)).withColumnsRenamed({f"_x{i}": f"in_{c}" for i, c in enumerate(extra)})

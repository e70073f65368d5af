"""SentencePiece encoding and decoding with a distinct-chunk table.

Method. If no piece of the vocabulary holds a white-space marker after another character
(`splits_at_markers` proves it from the vocabulary), segmentation never crosses the start of a marker
run. Each distinct marked word is then segmented once per task by the library, and the ids are joined
back by position. A vocabulary that fails the proof, or whose normaliser is not the identity with a
dummy prefix, is encoded text by text instead.

Nulls count as empty texts; an empty text encodes to the end id alone. Repeated rows each get their own
result and extra columns of the input are ignored. A very long text is a block of its own. Words are told apart by
their bytes; the word table is emptied beyond a bound, so memory does not follow the vocabulary of a corpus.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowquarry.llm.textcore import DistinctTable, byte_table, giving_back, per_text, text_blocks, units

MARK = "▁"
_BLANK = byte_table(b" ")
_AFTER_MARK = byte_table(b"\x81")  # the last byte of U+2581: a run of markers may have begun there


@functools.lru_cache(4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(4)
def splits_at_markers(path: str) -> bool:
    """Whether marked words can be segmented one by one."""
    sp = load(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return False
    # the normaliser: probes show the dummy prefix, kept runs of blanks and no other change
    probe = "a  b\t ﬁ́ \n"
    return sp.decode(sp.encode(probe)) == probe and sp.encode("a") == sp.encode_as_ids("a") and sp.id_to_piece(sp.encode("a"))[0].startswith(MARK)


def _segment(sp):
    """For DistinctTable: (ids as decimal bytes, id count, decoded bytes) of each marked word, its first marker implied."""
    lone = [sp.piece_to_id(MARK)]

    def compute(chunks: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        # a chunk begins with the blank that the dummy prefix stands for; the library adds none to an empty text
        found = [ids or lone for ids in sp.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)]
        decoded = sp.decode(found, num_threads=1)
        return [(" ".join(map(str, ids)).encode(), len(ids), d.encode()) for ids, d in zip(found, decoded)]

    return compute


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (decimal, joined by blanks, end id last) and decoded (the library's decoding of them)."""
    return _run(docs, model, id_col, text_col, False)


def encode_decode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 digests taken in the task in place of the two texts."""
    return _run(docs, model, id_col, text_col, True)


def _names(id_col: str, digests: bool) -> list[str]:
    return [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]


def _task(model: str, id_col: str, digests: bool):
    finish = (lambda b: hashlib.sha256(b).hexdigest()) if digests else (lambda b: b.decode("utf-8", "replace"))
    names = _names(id_col, digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        eos, by_word, table = sp.eos_id(), splits_at_markers(model), DistinctTable()
        end = str(eos).encode()
        compute = _segment(sp)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                counts, ids, decoded = [], [], []
                if by_word:
                    data, offsets = _with_prefix(data, offsets)
                    starts, ends, first = units(data, offsets, _BLANK, _AFTER_MARK)
                    slots = table.lookup(data, starts, ends, compute)
                    values = table.values
                    lengths = np.fromiter((v[1] for v in values), np.int64, len(values))
                    counts = (per_text(lengths[slots], first) + 1).tolist()
                    at, bounds = slots.tolist(), first.tolist()
                    for x, y in zip(bounds, bounds[1:]):
                        own = [values[k] for k in at[x:y]]
                        ids.append(finish(b" ".join([v[0] for v in own] + [end])))
                        decoded.append(finish(b" ".join([v[2] for v in own])))
                else:
                    for x, y in zip(offsets.tolist(), offsets[1:].tolist()):
                        found = sp.encode(data[x:y].tobytes().decode("utf-8", "replace")) + [eos]
                        counts.append(len(found))
                        ids.append(finish(" ".join(map(str, found)).encode()))
                        decoded.append(finish(sp.decode(found).encode()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=names)

    return run


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    _, _, ids, decoded = _names(id_col, digests)
    return rows.mapInArrow(giving_back(_task(model, id_col, digests)), f"`{id_col}` long, n_tokens long, `{ids}` string, `{decoded}` string")


def _with_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put a blank, which stands for the dummy prefix, before every text that is not empty."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate([[0], np.cumsum(full)])

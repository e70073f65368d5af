"""Token counts by the whole-token shortcut.

Method. A byte-level BPE splits a text into pre-tokens and merges each by itself. Vocabulary strings
that the library encodes alone as one token are proved once from the vocabulary file (`whole_tokens`);
a pre-token that is such a string counts one, and only the rest is merged by the library. Texts are cut
before white-space runs, where no pre-token can cross, and each distinct piece is counted once per task. That the
file's own normaliser and pre-tokeniser are those that this rests on is read from the file (`splits_as_assumed`);
any other vocabulary is counted text by text by the library.

Nulls count as empty texts. Pieces are told apart by their bytes. A very long text is a block of its own; an empty table
gives no rows. Rows are never joined or grouped: repeated rows each get their own result,
and extra columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowquarry.llm.textcore import SPACE, CountTable, byte_table, giving_back, per_text, text_blocks, units

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Last bytes of white space outside ASCII (U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000):
#: after such a byte the white-space run may have begun earlier, so no cut is made there.
WIDE_SPACE_END = byte_table(bytes([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))


@functools.lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def parts(path: str) -> dict:
    """The tokenizer file's own description, without vocabulary and merges."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return found | {"model": {k: v for k, v in found["model"].items() if k not in ("vocab", "merges")}}


def plain_special(found: dict) -> bool:
    """Whether special strings are found as they stand, hold no white space and take none from around them."""
    return not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in found["added_tokens"])


@functools.lru_cache(4)
def splits_as_assumed(path: str) -> bool:
    """Whether the file splits texts by PRETOKEN and changes nothing before that."""
    found = parts(path)
    split = dict(found["pre_tokenizer"] or {})
    return (
        found["normalizer"] is None and plain_special(found) and found["model"].get("type") == "BPE" and not found["model"].get("dropout")
        and split.pop("type", None) == "ByteLevel" and split.pop("add_prefix_space", True) is False and split.pop("use_regex", True) is True
    )


@functools.lru_cache(4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as exactly one token."""
    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pattern = regex.compile(PRETOKEN)
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    texts = [t for t in texts if t and t not in special and "�" not in t and pattern.fullmatch(t)]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found) if len(e.ids) == 1)


class TokenCounter:
    """Counts tokens of distinct pieces of text with one vocabulary."""

    def __init__(self, path: str):
        self.tokenizer, self.whole, self.pattern = load(path), whole_tokens(path), regex.compile(PRETOKEN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged: dict[str, int] = {}

    def __call__(self, pieces: list[bytes]) -> list[int]:
        counts, rest, todo = [0] * len(pieces), {}, []
        for i, raw in enumerate(pieces):
            text = raw.decode("utf-8", "replace")
            if text in self.whole:
                counts[i] = 1
            elif any(s in text for s in self.special):
                counts[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                for part in self.pattern.findall(text):
                    if part in self.whole:
                        counts[i] += 1
                    else:
                        todo.append((i, part))
                        rest.setdefault(part)
        new = [p for p in rest if p not in self.merged]
        if len(self.merged) + len(new) > 400_000:
            self.merged, new = {}, list(rest)
        for part, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.merged[part] = len(got.ids)
        for i, part in todo:
            counts[i] += self.merged[part]
        return counts


def _by_text(batches: Iterator[pa.RecordBatch], library, id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        yield pa.record_batch([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not splits_as_assumed(tokenizer):
            yield from _by_text(batches, load(tokenizer), id_col)
            return
        counter, table = TokenCounter(tokenizer), CountTable()
        for batch in batches:
            sizes, tokens = [], []
            for _, _, data, offsets in text_blocks(batch.column(1)):
                starts, ends, first = units(data, offsets, SPACE, WIDE_SPACE_END)
                slots = table.lookup(data, starts, ends, counter)
                sizes.append(np.diff(offsets))
                tokens.append(per_text(table.values[slots], first))
            if sizes:
                yield pa.record_batch([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], names=[id_col, "n_bytes", "n_tokens"])

    ids = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    out = ids.mapInArrow(giving_back(count), f"`{id_col}` long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", out["n_tokens"] > limit)

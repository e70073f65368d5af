"""Packing documents into fixed windows by best-fit decreasing.

Method. A document is tokenised, an end id is added, and it is cut into full windows and one remainder
(`pieces`). Best-fit decreasing over the remainders depends only on how many have each length, so the
plan is made from that histogram, which has at most `window` entries: lengths fall from large to small, and
a segment tree indexed by remaining capacity finds the tightest open window that still fits. Windows that
were filled alike are kept together as a range, so the plan's size depends on the window and not on the
number of documents. Every piece then finds its window by its rank among the pieces of its length.

Ranks are counted per (length, salt), where the salt is a hash, and the salts' counts are added up
before; a length that most documents share is thus spread over many tasks.

Nulls count as empty texts (a document is then its end id alone). Repeated rows are packed each by itself, and so are
equal ids; pieces of one length are ranked by id, start and the other columns, so ties change no piece's ids. An empty table
has no pieces. A very long text is a block of its own and so many pieces. Extra columns are ignored by `pieces` and kept by
`assign`. Words of a task are told apart by their bytes. A tokenizer file whose words are not separate by its own description is run over whole texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.stage import settled
from flowquarry.llm.textcore import SPACE, RunTable, byte_table, cut, gathered, giving_back, text_blocks, words
from flowquarry.llm.tokencount import load, parts, plain_special

SALTS = 256
WINDOW_TOKENS = 4096


#: The normaliser and the first pre-tokeniser of word-end vocabularies of this family.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@functools.lru_cache(4)
def words_are_separate(path: str) -> bool:
    """Whether white space, and punctuation after a letter, only separate words.

    The file's normaliser and pre-tokeniser have to be the known ones: composing, folding white space and case go
    character by character and no composition crosses white space or a letter's end before `_CUT`; letters, digits
    and other characters are pre-tokens of their own. Probes on many kinds of words are held against the library.
    """
    found = parts(path)
    if not plain_special(found) or found["normalizer"] != NORMALIZER or (found["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] != SPLIT:
        return False
    t = load(path)
    probes = ["Ab1", "'s", "é", "́x", "##", "中文", "İ", "ΑΣ", "1", "…", "x's"]
    alone = {p: t.encode(p, add_special_tokens=False).ids for p in probes}
    whole = all(t.encode(f"{a}{c}{b}", add_special_tokens=False).ids == t.encode(a, add_special_tokens=False).ids + t.encode(f"{c}{b}", add_special_tokens=False).ids for a in ("ab", "é", "7", "ÀÖ") for c in ',.;:!?%&*$#")(' for b in ("", "x", "'s", ".", "́"))
    return whole and all(
        t.encode(f"{a}{s}{b}", add_special_tokens=False).ids == alone[a] + alone[b] for a in probes for b in probes for s in (" ", "\n", " \t ")
    )


LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


@functools.lru_cache(4)
def letter_words(path: str):
    """(tokenizer, table) for words of LETTERS, or None if the file isn't of the known kind.

    Composed letters are what NFC gives, they are lower-cased alike by Python, and such a word is one pre-token. So the library's
    model gets them without its normaliser and pre-tokeniser: lower-cased, by the table of byte letters, cut at white space.
    """
    if not words_are_separate(path) or parts(path)["pre_tokenizer"]["pretokenizers"][1:] != [BYTE_LEVEL]:
        return None
    from tokenizers import Tokenizer, pre_tokenizers

    letters = [chr(c) for c in range(256) if LETTERS.fullmatch(chr(c))]
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters if ord(c) > 127}
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    found.normalizer, found.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
    probes = " ".join(letters + [a + b for a in letters for b in letters] + ["".join(letters[k:] + letters[:k]) for k in range(0, len(letters), 7)])
    same = found.encode(probes.lower().translate(table), add_special_tokens=False).ids == load(path).encode(probes, add_special_tokens=False).ids
    return (found, table) if same else None


#: Punctuation before which a word may be cut: no apostrophe, and nothing that special tokens hold.
_CUT = byte_table(b',.;:!?%&*$#")(')
_ASCII_WORD = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))


class WordEncoder:
    """Ids of words, each encoded by itself. Words of Latin letters are one pre-token, so many of them are
    encoded at once and told apart by the vocabulary's word ends."""

    def __init__(self, path: str, chunk: int = 500):
        self.tokenizer, self.chunk, self.letters = load(path), chunk, letter_words(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, texts: list[str]) -> list[np.ndarray]:
        """The same of words of Latin letters with spaces between them."""
        if self.letters is None:
            return self._encode(texts)
        tokenizer, table = self.letters
        low = [t.lower() if t.isascii() else t.lower().translate(table) for t in texts]
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(low, add_special_tokens=False)]

    def __call__(self, words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words_]
        plain = [i for i, t in enumerate(texts) if t.isascii() and t.isalpha()]  # these need no table
        accented = [i for i, t in enumerate(texts) if not t.isascii() and LETTERS.fullmatch(t)]
        groups = [own[i : i + self.chunk] for own in (plain, accented) for i in range(0, len(own), self.chunk)]
        runs, order, lengths, done = [], [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for own, ids in zip(groups, self._encode_letters([" ".join([texts[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):  # else they are encoded one by one below
                runs.append(ids)
                order.append(own)
                lengths[own], done[own] = np.diff(ends, prepend=0), True
        rest = np.flatnonzero(~done)
        for i, ids in zip(rest.tolist(), self._encode([texts[i] for i in rest])):
            runs.append(ids)
            lengths[i] = len(ids)
        order = np.concatenate([*order, rest]).astype(np.int64)
        heads = np.empty(len(texts), np.int64)
        heads[order] = np.cumsum(lengths[order]) - lengths[order]  # where each word's ids begin in the runs
        return gathered(np.concatenate(runs), heads, lengths), lengths


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut once more where punctuation follows a letter or digit: the pre-tokeniser cuts there too."""
    starts, ends, first = words(data, offsets, SPACE)
    if len(data) < 2:
        return starts, ends, first
    after = _ASCII_WORD[data[:-1]]
    after[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & (data[1:-1] >= 0x80)  # Latin-1 letters
    return cut(starts, ends, np.flatnonzero(after & _CUT[data[1:]]) + 1, first)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, doc_tokens, and ids (little-endian unsigned 32-bit, `length` of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, separate = WordEncoder(tokenizer), RunTable(), words_are_separate(tokenizer)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                if separate:
                    starts, ends, first = word_parts(data, offsets)
                else:
                    full = np.flatnonzero(np.diff(offsets))
                    starts, ends = offsets[full], offsets[full + 1]
                    first = np.searchsorted(full, np.arange(len(offsets)))
                flat, lengths = table.joined(table.lookup(data, starts, ends, encoder))
                heads = np.concatenate([[0], np.cumsum(lengths)])[first].tolist()
                rows, start, size, total, ids = [], [], [], [], []
                end = np.array([end_id], np.uint32)
                for i, (x, y) in enumerate(zip(heads, heads[1:])):
                    own = np.concatenate([flat[x:y], end])
                    for s in range(0, len(own), window):
                        rows.append(a + i)
                        start.append(s)
                        size.append(min(window, len(own) - s))
                        total.append(len(own))
                        ids.append(own[s : s + window].astype("<u4").tobytes())
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, size, total)), pa.array(ids, pa.binary())],
                    names=[id_col, "start", "length", "doc_tokens", "ids"],
                )

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return rows.mapInArrow(giving_back(run), f"`{id_col}` long, start long, length long, doc_tokens long, ids binary")


class TightestFit:
    """A segment tree over capacities 0 .. size: which hold open windows, and the smallest such at or above a bound."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.full = bytearray(2 * self.leaves)

    def put(self, capacity: int, has: bool) -> None:
        node = capacity + self.leaves
        self.full[node] = has
        while node > 1:
            node >>= 1
            self.full[node] = self.full[2 * node] | self.full[2 * node + 1]

    def find(self, least: int) -> int | None:
        """The smallest capacity >= least with an open window."""
        node = least + self.leaves
        if not self.full[node]:
            while node > 1 and (node & 1 or not self.full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.full[2 * node])
        return node - self.leaves


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over `counts[length]` pieces of each length.

    Rows (length, rank_from, n, each, sequence_from, offset): pieces of this length with rank rank_from + i, i < n,
    lie in window sequence_from + i // each, at offset + (i % each) * length. The windows are those that placing the
    pieces one by one would open.
    """
    tree, open_at = TightestFit(window), {}  # capacity -> ranges (first window, number of windows)
    plan, windows = [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.find(length)
            if capacity is None:
                capacity, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_at[capacity].pop()
                if not open_at[capacity]:
                    tree.put(capacity, False)
            each = capacity // length  # once tightest, a window stays so until no further piece fits
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, window - capacity))
                leave(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                plan.append((length, rank, left, each, first, window - capacity))
                leave(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            leave(capacity, first, n)
    return plan


def assign(parts: DataFrame, window: int = WINDOW_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces: any frame with id, start and length, read twice, so write it first if it is dear."""
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.col("start")), F.lit(SALTS)))
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # at most window * SALTS rows, whatever the input
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = by_salt.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `window` rows
    spark = parts.sparkSession
    plan = spark.createDataFrame(
        best_fit_plan(counts, window), "length long, _rank_from long, _many long, _each long, _first long, _at long"
    ).withColumnRenamed("length", "_length")
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "start", *[c for c in parts.columns if c not in (id_col, "start")])
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1)
    heads = heads.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), "_before")
    ranked = ranked.join(heads, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_own") + F.col("_before"))
    # the plan's size is bounded by the window alone
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_rank_from")) & (F.col("_rank") < F.col("_rank_from") + F.col("_many")),
    )
    i = F.col("_rank") - F.col("_rank_from")
    keep = [F.col(c) for c in parts.columns]
    return placed.select(
        *keep,
        (F.col("_first") + F.floor(i / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(i, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces with their ids."""
    return assign(settled(pieces(docs, tokenizer, end_id, window, id_col, text_col)), window, id_col)


def padded_length(used: int, window: int = WINDOW_TOKENS) -> int:
    """What a sequence of `used` tokens is padded to: the window, except at a power of two, which stays."""
    return used if used & (used - 1) == 0 else window

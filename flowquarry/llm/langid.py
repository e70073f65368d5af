"""Language identification by a linear-chain conditional random field over words.

Method. A text's words are its runs of letters. Each word has features: its first and last bytes (affixes of 1 to 3), its byte
n-grams of 2 to 4 with the word's ends marked, the word itself, and how well it is known in each language's lexicon, in
steps. A language's weight for a word is the sum over the features; between neighbouring words stand learned transition
weights. Weights maximise the likelihood of labelled word sequences, in which stretches of different texts follow one another,
so that switches of language are learned too. Forward-backward gives each word's distribution over languages, which labels
the words of code-switched text (`label_words`); a text's language has the largest share of its words (`identify`), and
the score is that share. Ties go to the language that sorts first.

Features are hashed into `FEATURES` weights. Long texts are handled exactly: products of transition and word matrices are
formed over stretches of `STRETCH` words, messages pass between stretches, and then inside of them.

Scale. The lexicon counts the words of every training text, in `LEXICON` hashed buckets, so it has a fixed size. The weights are
fitted on a bounded sample: at most `SAMPLE` stretches of each language, chosen by hash from the stretches of all training
texts (a documented parameter); a training stretch's own words are taken out of the lexicon for the fit. A text is
read and labelled in one pass, and no text is shuffled.

Cases. A null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned. Texts without an id or
a language are not learned from, and a null id is not held out. Repeated rows get equal results. Extra columns take no part.
In training stretches, words over `LONGEST` bytes are left out; predictions use all words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.textcore import LOWER, DistinctTable, giving_back, mix, span_hash, spans, text_blocks, text_of

FEATURES, LEXICON, LEVELS = 1 << 15, 1 << 18, 8
STRETCH, SAMPLE, LONGEST = 64, 500, 64
ROUNDS, RATE, PENALTY = 25, 0.5, 1e-3
NONE = "und"
_U = np.uint64


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters, or marks that belong to them."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _base_letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _points(data: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at `lead` and have `size` bytes."""
    code = data[lead].astype(np.int64)
    for n, bits in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        own = size == n
        point = code[own] & bits
        for k in range(1, n):
            point = point << 6 | data[lead[own] + k].astype(np.int64) & 0x3F
        code[own] = point
    return np.minimum(code, 0x10FFFF)


_ASCII = np.array([chr(c).isalpha() if c < 128 else False for c in range(256)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (marks after them included) of a block of UTF-8 texts, as `spans` gives them."""
    keep = _ASCII[data]
    real = keep
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
        size = np.minimum(size, len(data) - lead)
        code = _points(data, lead, size)
        at = np.repeat(lead - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        real = keep.copy()
        keep[at], real[at] = np.repeat(letters()[code], size), np.repeat(_base_letters()[code], size)
    starts, ends, first = spans(keep, offsets)
    if real is keep:
        return starts, ends, first
    # a run of marks alone is no word
    count = np.concatenate([[0], np.cumsum(real, dtype=np.int32)])
    ok = count[ends] > count[starts]
    if ok.all():
        return starts, ends, first
    return starts[ok], ends[ok], np.concatenate([[0], np.cumsum(ok)])[first]


def lexicon_levels(lexicon: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word bucket and language: 0 if unseen there, else a step of its share among the languages."""
    rate = lexicon[at] / np.maximum(1.0, lexicon.sum(axis=0))
    total = rate.sum(axis=1, keepdims=True)
    share = np.divide(rate, total, out=np.zeros_like(rate), where=total > 0)
    return np.where(rate > 0, 1 + np.minimum(LEVELS - 2, (share * (LEVELS - 1)).astype(np.int64)), 0)


def word_features(texts: list[bytes], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features, and the word that each belongs to."""
    n, size = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join([b"\x02" + t + b"\x03" for t in texts]), np.uint8)
    ends = np.cumsum(size + 2)
    starts = ends - size - 2
    word = np.repeat(np.arange(n), size + 2)
    left = ends[word] - np.arange(len(data))  # bytes to the word's end
    every, parts, owners = np.arange(n), [], []

    def add(value: np.ndarray, own: np.ndarray, kind: int) -> None:
        value *= _U(0x9E3779B97F4A7C15)
        parts.append((mix(value + _U(kind * 0xBF58476D1CE4E5B9 % 2**64)) >> _U(64 - 15)).astype(np.int64))
        owners.append(own)

    gram = data.astype(np.uint64)
    for width in range(1, 5):
        if width > 1:
            gram = gram[:-1] << _U(8) | data[width - 1 :]
            ok = left[: len(gram)] >= width
            add(gram[ok], word[: len(gram)][ok], width)
        if width < 4:
            for edge, at in ((5, starts + 1), (9, ends - 1 - width)):  # affixes
                long_enough = size >= width
                add(gram[at[long_enough]], every[long_enough], edge + width)
    whole = span_hash(data, starts + 1, ends - 1)
    add(whole.copy(), every, 15)
    levels = lexicon_levels(lexicon, (whole >> _U(64 - 18)).astype(np.int64))
    for k in range(levels.shape[1]):
        add(levels[:, k].astype(np.uint64), every, 16 + k)
    return np.concatenate(parts), np.concatenate(owners)


def emissions(features: np.ndarray, owners: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """A weight for each of n words and each language."""
    return np.stack([np.bincount(owners, w.take(features), n) for w in np.ascontiguousarray(weights.T)], axis=1)


class Chains:
    """Forward-backward over many sequences at once, in stretches of `STRETCH` words side by side."""

    EVERY = 8  # steps between two scalings; a step shrinks the largest entry by a bounded factor, as each word's best potential is 1

    def __init__(self, emission: np.ndarray, first: np.ndarray, transition: np.ndarray):
        """emission: a row a word; first: where each sequence's words begin, and the end."""
        n = np.diff(first)
        pieces = -(-n // STRETCH)
        self.sequence = np.repeat(np.arange(len(n)), pieces)
        self.turn = np.arange(len(self.sequence)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[self.sequence] + self.turn * STRETCH
        size = np.minimum(STRETCH, first[self.sequence + 1] - start)
        # the longest stretches first, so that those that still go on are the first ones
        order = np.argsort(-size, kind="stable")
        self.sequence, self.turn, start, self.size = self.sequence[order], self.turn[order], start[order], size[order]
        self.steps = int(self.size.max(initial=0))
        self.active = np.searchsorted(-self.size, -np.arange(self.steps), "left").tolist()  # those of more than t words
        # each word's place among (step, stretch)
        piece = np.repeat(np.arange(len(self.size)), self.size)
        t = np.arange(len(piece)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = np.empty(len(emission), np.int64)
        self.place[start[piece] + t] = t * len(self.size) + piece
        k = len(transition)
        self.potential = np.ones((self.steps * len(self.size), k))
        self.potential[self.place] = np.exp(emission - emission.max(axis=1, keepdims=True))
        self.potential = self.potential.reshape(self.steps, len(self.size), k)
        self.step = np.exp(transition - transition.max())

    def _links(self) -> tuple[np.ndarray, np.ndarray]:
        """Messages that enter each stretch from the words before, and from those after."""
        s, k = len(self.size), len(self.step)
        into, back = np.full((s, k), 1 / k), np.ones((s, k))
        if self.turn.max(initial=0) == 0:
            return into, back
        product = np.tile(np.eye(k), (s, 1, 1))
        for t, a in enumerate(self.active):
            m = (product[:a].reshape(-1, k) @ self.step).reshape(a, k, k)
            m *= self.potential[t, :a, None, :]
            if t % self.EVERY == 0:
                m /= m.sum(axis=(1, 2), keepdims=True)
            product[:a] = m
        product /= product.sum(axis=(1, 2), keepdims=True)
        where = np.lexsort((self.turn, self.sequence))  # stretches in the order of their texts
        turn = self.turn[where]
        by_turn = np.argsort(turn, kind="stable")
        bounds = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        for j in range(1, len(bounds) - 1):
            at = by_turn[bounds[j] : bounds[j + 1]]
            m = np.einsum("ni,nij->nj", into[where[at - 1]], product[where[at - 1]])
            into[where[at]] = m / m.sum(axis=1, keepdims=True)
        for j in range(len(bounds) - 2, 0, -1):
            at = by_turn[bounds[j] : bounds[j + 1]]
            m = np.einsum("nij,nj->ni", product[where[at]], back[where[at]])
            back[where[at - 1]] = m / m.sum(axis=1, keepdims=True)
        return into, back

    def posteriors(self, pairs: np.ndarray | None = None) -> np.ndarray:
        """Each word's distribution over languages. pairs: gets the expected transitions added."""
        into, back = self._links()
        k = len(self.step)
        forward = np.empty_like(self.potential)
        message = into
        for t, a in enumerate(self.active):
            m = message[:a] @ self.step
            m *= self.potential[t, :a]
            if t % self.EVERY == 0:
                m /= m.sum(axis=1, keepdims=True)
            forward[t, :a] = message = m
        out, turned = np.empty_like(forward), np.ascontiguousarray(self.step.T)
        message = back.copy()
        for t in range(self.steps - 1, -1, -1):
            a = self.active[t]
            np.multiply(forward[t, :a], message[:a], out=out[t, :a])
            behind = self.potential[t, :a] * message[:a]
            if pairs is not None:
                before = into[:a] if t == 0 else forward[t - 1, :a]
                scale = ((before @ self.step) * behind).sum(axis=1)
                pairs += self.step * ((before / scale[:, None]).T @ behind)
            m = behind @ turned
            if t % self.EVERY == 0:
                m /= m.sum(axis=1, keepdims=True)
            message[:a] = m
        found = out.reshape(-1, k)[self.place]
        return found / (found @ np.ones(k))[:, None]


class Model:
    """Languages, feature weights, transition weights and the lexicon's counts."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, lexicon: np.ndarray):
        self.languages, self.weights, self.transition, self.lexicon = languages, weights, transition, lexicon

    def word_weights(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for i in range(0, len(texts), 20_000):  # bounds the memory of the features
            own = texts[i : i + 20_000]
            out.append(emissions(*word_features(own, self.lexicon), self.weights, len(own)))
        return np.concatenate(out)


class _Weights(DistinctTable):
    """A row of weights for each word."""

    def __init__(self, width: int):
        self.width = width
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.values = np.zeros((0, self.width), np.float32)

    def extend(self, values) -> None:
        self.values = np.concatenate([self.values, values.astype(np.float32)])


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), docs[id_col].alias("id"))
    return rows.where(F.col("id").isNotNull() & ~is_held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")


def count_words(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """How often the words of each lexicon bucket occur in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), LEXICON), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, b, data, offsets in text_blocks(batch.column(0)):
                data = LOWER[data]
                starts, ends, first = words(data, offsets)
                at = (span_hash(data, starts, ends) >> _U(64 - 18)).astype(np.int64)
                sums += np.bincount(lang[a:b][text_of(starts, first)] * LEXICON + at, minlength=sums.size).reshape(sums.shape)
        own = np.flatnonzero(sums.any(axis=0))
        yield pa.record_batch([pa.array(own), pa.array(sums[:, own].T.tolist(), pa.list_(pa.int64()))], names=["bucket", "n"])

    parts = rows.mapInArrow(giving_back(count), "bucket long, n array<long>").select("bucket", F.posexplode("n").alias("lang", "n"))
    found = parts.groupBy("bucket", "lang").agg(F.sum("n").alias("n")).where("n > 0").toArrow()  # at most LEXICON rows a language
    out = np.zeros((LEXICON, len(languages)), np.float32)
    out[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    return out


def sample_stretches(rows: DataFrame, limit: int) -> list[tuple[str, bytes]]:
    """(lang, words joined by blanks) of at most `limit` stretches of each language, chosen by hash among those of all texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for a, _, data, offsets in text_blocks(batch.column(0)):
                data = LOWER[data]
                starts, ends, first = words(data, offsets)
                ok = ends - starts <= LONGEST
                first = np.concatenate([[0], np.cumsum(ok)])[first]
                starts, ends = starts[ok], ends[ok]
                if not len(starts):
                    continue
                pos = np.arange(len(starts)) - first[text_of(starts, first)]
                heads = np.flatnonzero(pos % STRETCH == 0)
                tails = np.append(heads[1:], len(starts))
                h = span_hash(data, starts[heads], ends[tails - 1], 13)
                raw, text = data.tobytes(), text_of(starts, first)[heads]
                for i, x, y, key in zip(text.tolist(), heads.tolist(), tails.tolist(), (h >> _U(1)).tolist()):
                    held = best.setdefault(lang[a + i], [])
                    if len(held) < 2 * limit or key < held[limit - 1][0]:
                        held.append((key, b" ".join([raw[s:e] for s, e in zip(starts[x:y].tolist(), ends[x:y].tolist())])))
                        if len(held) >= 3 * limit:
                            held.sort()
                            del held[limit:]
        for x, held in best.items():
            held = sorted(set(held))[:limit]
            yield pa.record_batch([pa.array([x] * len(held)), pa.array([k for k, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary())], names=["lang", "h", "words"])

    found = rows.mapInArrow(giving_back(cut), "lang string, h long, words binary").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
    return [(r["lang"], bytes(r["words"])) for r in found.withColumn("n", rank).where(F.col("n") <= limit).orderBy("h", "lang").collect()]


def fit(stretches: list[tuple[str, bytes]], languages: list[str], lexicon: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights by gradient steps (one rate a weight) on the likelihood. Every two neighbours of the sample, of any languages, are one sequence."""
    number = {x: i for i, x in enumerate(languages)}
    tokens = [t.split(b" ") for _, t in stretches]
    label = np.concatenate([np.full(len(w), number[x], np.int64) for (x, _), w in zip(stretches, tokens)])
    slot: dict[bytes, int] = {}
    at = np.fromiter((slot.setdefault(w, len(slot)) for own in tokens for w in own), np.int64, len(label))
    first = np.concatenate([[0], np.cumsum([len(w) for w in tokens])])
    first = np.unique(np.append(first[::2], first[-1]))
    distinct, k = list(slot), len(languages)
    # the lexicon without the sample, as it is for words of other texts
    data = np.frombuffer(b"".join(distinct), np.uint8)
    ends = np.cumsum([len(w) for w in distinct])
    bucket = (span_hash(data, ends - np.array([len(w) for w in distinct]), ends) >> _U(64 - 18)).astype(np.int64)
    rest = lexicon.copy()
    np.subtract.at(rest, (bucket[at], label), 1)
    features, owner = word_features(distinct, np.maximum(rest, 0))
    weights, transition = np.zeros((FEATURES, k)), np.zeros((k, k))
    truth = np.eye(k)[label]
    inner = np.ones(len(label), bool)
    inner[first[:-1]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    seen += truth[first[:-1]].sum(axis=0) / k  # before a sequence stands any language alike
    squares, steps = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    for _ in range(rounds):
        pairs = np.zeros((k, k))
        own = emissions(features, owner, weights, len(distinct))
        gap = truth - Chains(own[at], first, transition).posteriors(pairs)
        by_word = np.stack([np.bincount(at, gap[:, j], len(distinct)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(features, w.take(owner), FEATURES) for w in np.ascontiguousarray(by_word.T)], axis=1) / len(label) - PENALTY * weights
        squares += gradient * gradient
        weights += RATE * gradient / np.sqrt(squares)
        gradient = (seen - pairs) / len(label) - PENALTY * transition
        steps += gradient * gradient
        transition += RATE * gradient / np.sqrt(steps)
    return Model(languages, weights, transition, lexicon)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """A model of all texts that are not held out and have a language; None if there is none."""
    rows = _training_rows(docs, id_col, text_col, lang_col)
    stretches = sample_stretches(rows, sample)
    languages = sorted({x for x, _ in stretches})
    if not languages:
        return None
    return fit(stretches, languages, count_words(rows.where(F.col("lang").isin(languages)), languages), rounds)


def _labelled(model: Model, column: pa.Array, table: _Weights) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: bytes, word starts and ends, the first word of each text, each word's distribution."""
    for _, _, data, offsets in text_blocks(column):
        starts, ends, first = words(data, offsets)
        slots = table.lookup(LOWER[data], starts, ends, model.word_weights)
        yield data, starts, ends, first, Chains(table.values[slots], first, model.transition).posteriors()


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred and score."""
    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text"), is_held_out(docs[id_col]).alias("held_out"))
    if model is None:
        return rows.select(id_col, "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: features, buckets, languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k, table = len(own.languages), _Weights(len(own.languages))
        names = np.array([*own.languages, NONE], object)
        for batch in batches:
            best, score = [], []
            for _, _, _, first, share in _labelled(own, batch.column(1), table):
                n = np.diff(first)
                text = text_of(share, first)
                mean = np.stack([np.bincount(text, share[:, j], len(n)) for j in range(k)], axis=1) / np.maximum(1, n)[:, None]
                top = np.where(n > 0, mean.argmax(axis=1), k)
                best.append(names[top])
                score.append(np.where(n > 0, np.clip(mean.max(axis=1), 0.0, 1.0), 0.0))
            if best:
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.concatenate(best), pa.string()), pa.array(np.concatenate(score))], names=[id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(giving_back(run), f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and words, an array of (word, lang, score) for the words of code-switched text."""
    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = _Weights(len(own.languages))
        for batch in batches:
            out = []
            for data, starts, ends, first, share in _labelled(own, batch.column(1), table):
                raw, top = data.tobytes(), share.argmax(axis=1)
                found = [{"word": raw[s:e].decode("utf-8", "replace"), "lang": own.languages[i], "score": float(share[j, i])} for j, (s, e, i) in enumerate(zip(starts.tolist(), ends.tolist(), top.tolist()))]
                out += [found[x:y] for x, y in zip(first.tolist(), first[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], names=[id_col, "words"])

    return rows.mapInArrow(giving_back(run), f"`{id_col}` long, words array<struct<word:string,lang:string,score:double>>")

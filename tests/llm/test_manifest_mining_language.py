import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import hardneg, langid, merkle, queries

SF = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(r, text):
    fields = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row."""

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def beside(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = beside(trees[g], i) + beside(top, k)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = plain_leaf(r, text)
            for a, b in path:
                h = sha(a + h + b)
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


def test_addresses_are_a_layout():
    for levels in range(1, 6):
        places = np.concatenate([merkle.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.tree_size(levels)))
    # an aligned subtree is one stretch
    own = np.concatenate([merkle.address(4, 2 + d, np.arange(8**d) + 5 * 8**d) for d in range(2)])
    assert own.max() - own.min() == 8


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 4096])
def test_block_paths(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree, root = merkle.grow(leaves, merkle.rise(n))
    paths = list(merkle.Block(tree, n, merkle.rise(n)).paths())
    assert len(paths) == n and all(merkle.fold(x, p) == root for x, p in zip(leaves, paths))


def test_manifest(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"Text {i} É", rng.choice(["en", "en", "en", "de", "é", None]), None if i % 5 == 0 else f"s{i % 3}", i, "x", i) for i in range(3000)]
    rows += [(10_000 + i, "A" * (i % 9), "big", "s", i, "x", 0) for i in range(4200)]
    rows += [(None, None, None, None, None, None, None), (7, "Twice", "en", "s", 1, "x", 1), (7, "Twice", "en", "s", 1, "x", 1), (8, "", "", "", 0, "", 0), (9, "L" * 300_000, "long", "s", 1, "x", 1)]
    spark.createDataFrame(rows, ROW).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_merkle(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(docs), key=key)
    assert not all(r["verified"] for r in found) and any(r["verified"] for r in found)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    for n in (1, 0):
        spark.createDataFrame([(1, "Text", "en", "s", 4, "x", 1)][:n], ROW).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        found = queries.op11_merkle(spark, str(tmp_path / f"{n}")).collect()
        assert len(found) == n and all(r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("") for r in found)


VEC = "vec_id long, embedding array<double>, label int, score double, rank string"


def plain_negatives(rows, positives=5, negatives=10):
    own = []
    for i, v, label in rows:
        if None not in (i, v, label) and v and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out, dot = [], lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in {(i, tuple(v), label) for i, v, label in own if i % 100 == 0}:
        scored = sorted((-dot(v, w), j, other) for j, w, other in own if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k, _) in enumerate(fits)]
    return out


def mined(spark, folder):
    return sorted(tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect())


@pytest.mark.parametrize("size, scale, numbers", [(64, 1.0, None), (70, 3e5, None), (3, 1e-3, None), (5, 1.0, 200)])
def test_hard_negatives(spark, tmp_path, size, scale, numbers, monkeypatch):
    if numbers:  # many blocks of either side
        monkeypatch.setattr(hardneg, "ROW_NUMBERS", numbers)
        monkeypatch.setattr(hardneg, "ANCHOR_NUMBERS", numbers // 8)
    rng = np.random.default_rng(size)
    middle = rng.standard_normal((3, size))
    rows = [(i, (scale * (middle[i % 3] + rng.standard_normal(size)) / np.sqrt(size)).tolist(), int(rng.integers(0, 3)), 0.0, "x") for i in range(1500)]
    rows += [(2000 + i, rows[100][1], i % 2, 0.0, "x") for i in range(60)]  # copies, so ties
    rows += [(200, rows[200][1], rows[200][2], 0.0, "x"), (300, rows[5][1], 1, 0.0, "x"), (3000, [0.0] * size, 1, 0.0, "x")]
    rows += [(4000, None, 1, 0.0, "x"), (4100, rows[0][1], None, 0.0, "x"), (4200, [float("nan")] * size, 1, 0.0, "x"), (4300, [None] * size, 1, 0.0, "x"), (None, rows[0][1], 1, 0.0, "x")]
    spark.createDataFrame(rows, VEC).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert mined(spark, str(tmp_path)) == sorted(plain_negatives([r[:3] for r in rows]))


def test_hard_negatives_of_none_and_of_unequal_lengths(spark, tmp_path):
    spark.createDataFrame([], VEC).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert mined(spark, str(tmp_path / "none")) == []
    spark.createDataFrame([(1, [1.0], 1, 0.0, "x"), (2, [1.0, 2.0], 1, 0.0, "x")], VEC).write.parquet(str(tmp_path / "odd" / "embeddings.parquet"))
    with pytest.raises(ValueError):
        mined(spark, str(tmp_path / "odd"))


@pytest.mark.parametrize("size", [3, 64, 200])
def test_intervals_hold_the_scores(size):
    rng = np.random.default_rng(1)
    rows = np.floor(256 * np.concatenate([rng.standard_normal((300, size)), np.zeros((1, size)), np.eye(size)[:1], 50 * rng.standard_normal((20, size))]))
    anchors = np.concatenate([rows[:20], rows[300:310]])
    low, high = hardneg.Planes(anchors).bounds(slice(0, 30), *hardneg.coded(rows))
    exact = anchors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 2.5 * np.abs(anchors).max() * np.abs(rows).max() * size


def plain_posteriors(emission, transition):
    e, a = np.exp(emission), np.exp(transition)
    n, k = e.shape
    forward, backward = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        m = ((np.full(k, 1 / k) if t == 0 else forward[t - 1]) @ a) * e[t]
        forward[t] = m / m.sum()
    for t in range(n - 2, -1, -1):
        m = a @ (e[t + 1] * backward[t + 1])
        backward[t] = m / m.sum()
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_over_stretches():
    rng = np.random.default_rng(2)
    sizes = [1, 64, 0, 65, 500, 3, 128, 0]
    emission, transition = rng.normal(0, 2, (sum(sizes), 3)), rng.normal(0, 2, (3, 3))
    first = np.concatenate([[0], np.cumsum(sizes)])
    pairs = np.zeros((3, 3))
    got = langid.Chains(emission, first, transition).posteriors(pairs)
    for a, b in zip(first, first[1:]):
        assert np.allclose(got[a:b], plain_posteriors(emission[a:b], transition))
    assert np.isclose(pairs.sum(), sum(sizes))  # one expected step a word


def test_words_are_runs_of_letters():
    texts = ["Élan-vital 12 über ́ x́y", "", "中文 🙂 a", "1 2 3"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = langid.words(data, bounds)
    got = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert got == ["Élan", "vital", "über", "x́y", "中文", "a"] and first.tolist() == [0, 4, 4, 6, 6]


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_of_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)


def test_language_of_odd_texts(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !", "de"), (None, "the that of and", None), (5, "word " * 50_000, "xx"), (5, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    out = {(r["doc_id"], i): r for i, r in enumerate(langid.identify(docs, model).collect())}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for (d, _), r in out.items() if d in (1, 2, 3))
    assert len(out) == 6 and [r["held_out"] for (d, _), r in out.items() if d is None] == [False]
    assert langid.identify(docs.limit(0), model).isEmpty()
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(blank) is None
    assert {r["lang_pred"] for r in langid.identify(blank, None).collect()} == {"und"}


def test_words_of_code_switched_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'es') and crc32(cast(doc_id as string)) % 3 = 1")
    texts = {lang: [" ".join(langid_words(r["text"])[:60]) for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(8).collect()] for lang in ("de", "es")}
    mixed = [(i, f"{a} {b}", len(a.split())) for i, (a, b) in enumerate(zip(texts["de"], texts["es"]))]
    out = langid.label_words(spark.createDataFrame(mixed, "doc_id long, text string, n int"), model).collect()
    right = total = 0
    for r in out:
        n = mixed[r["doc_id"]][2]
        right += sum((w["lang"] == "de") == (i < n) for i, w in enumerate(r["words"]))
        total += len(r["words"])
    assert right >= 0.97 * total


def langid_words(text):
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text)

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowquarry.llm import license, packing, quality, queries, simhash, spiece, substring, tokencount
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row long, _text string, n_words string, length long"
WIDE = [" ", "　", " ", "\u0085", "▁", "́", "é", "中", "🙂", "İ", "Σ", "\x00", "\r\n", "\t", "<|endoftext|>", "</s>", "'s", "12", "##", ",", "the", " The"]


def edge_rows():
    rng = random.Random(2)
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t", "a", "a b c", passage, passage, "x " + passage + " y", "Very long " + "word " * 30_000, "one\n" * 40, "All rights reserved. CC BY 4.0"]
    texts += ["".join(rng.choice(WIDE) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, i, "clash", "clash", 5) for i, t in enumerate(texts)]
    return [*rows, (3, "a", 0, None, None, None), (None, "a b c d e f g h i j k l", 0, None, None, None)]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "docs.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r)))


@pytest.mark.parametrize("width, stored, coarse", [(3, False, 14), (5, True, 14), (35, True, 14), (3, True, 2), (35, False, 1)])
def test_substring(edges, documents, width, stored, coarse):
    for docs in (edges, documents):
        out = substring.substring_dedup(docs, width=width, bucket_bytes=1 << 12, flush=3000, stored=stored, coarse=coarse)
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()]
        assert key(got) == key(brute.substring(rows_of(docs), width))


def test_substring_keeps_columns_and_types(edges):
    out = substring.substring_dedup(edges, keep=("doc_id", "n_words", "_text"))
    assert out.columns[:3] == ["doc_id", "n_words", "_text"] and out.count() == edges.count()


def test_places_survive_another_cut_of_the_scan(spark, tmp_path):
    """Rows keep their places when the scan is cut into other tasks between a plan's making and its run."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).repartition(23).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    cut = substring.substring_dedup(docs, stored=True)
    once = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    expected = {d: k for d, _, _, k in brute.substring(rows_of(docs))}
    own = brute.classes({d: brute.fingerprint(t) for d, t in rows_of(docs)})
    try:
        for key, value in zip(keys, ("13", "1")):
            spark.conf.set(key, value)
        assert {r["doc_id"]: r["kept_text"] for r in cut.collect()} == expected
        assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(own.values()))
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_file_place(spark, tmp_path):
    from flowquarry.llm.stage import file_place

    spark.range(1000).withColumn("_metadata", F.lit("clash")).repartition(7).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    place, size = file_place(table)
    assert table.select(place.alias("p")).distinct().count() == 1000 and size > 0


def test_substring_query(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert got == {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute.substring(rows_of(docs))}


def test_token_counts(edges, documents):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = tokencount.load(path)
    for docs in (edges, documents):
        expected = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows_of(docs)]
        got = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(docs, path).where("over_limit = (n_tokens > 512)").collect()]
        assert key(got) == key(expected)


def test_other_vocabulary_files(spark, edges, tmp_path):
    """Files whose description differs are run over whole texts, and give the library's results all the same."""
    import json

    for name, change in (("byte_bpe_50k.json", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}), ("word_bpe_49k.json", {"normalizer": {"type": "NFC"}})):
        path = queries.tokenizer_path(name)
        assert tokencount.splits_as_assumed(path) == name.startswith("byte") and packing.words_are_separate(path) == name.startswith("word")
        other = str(tmp_path / name)
        with open(path) as f, open(other, "w") as g:
            json.dump(json.load(f) | change, g)
        assert not tokencount.splits_as_assumed(other) and not packing.words_are_separate(other)
        library = tokencount.load(other)
        counts = key([(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows_of(edges)])
        assert key([(r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(edges, other).collect()]) == counts
        got = packing.pieces(edges, other, 2).groupBy("doc_id").agg(F.sum("length").alias("n"))
        expected = {}
        for d, n in counts:
            expected[d] = expected.get(d, 0) + n + 1
        assert {r["doc_id"]: r["n"] for r in got.collect()} == expected


def test_sentencepiece_text_by_text(spark, documents, edges, monkeypatch):
    """The way without the word table, as run in a task: in this process, so that the proof can be made to fail."""
    import pyarrow as pa

    path = queries.tokenizer_path("piece_bpe_32k.model")
    monkeypatch.setattr(spiece, "splits_at_markers", lambda model: False)
    library, rows = spiece.load(path), rows_of(edges)
    run = spiece._task(path, "doc_id", False)
    out = [r for b in run(iter([pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])])) for r in b.to_pylist()]
    for (d, t), r in zip(rows, out, strict=True):
        ids = library.encode(t or "", add_eos=True)
        assert (r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) == (d, len(ids), " ".join(map(str, ids)), library.decode(ids))


def test_sentencepiece(edges, documents):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = spiece.load(path)
    for docs in (edges, documents):
        expected = []
        for d, t in rows_of(docs):
            ids = library.encode(t or "", add_eos=True)
            expected.append((d, len(ids), " ".join(map(str, ids)), library.decode(ids)))
        got = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in spiece.encode_decode(docs, path).collect()]
        assert key(got) == key(expected)


def test_sentencepiece_digests(edges):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert spiece.splits_at_markers(path)
    digests = spiece.encode_decode_digests(edges, path)
    whole = spiece.encode_decode(edges, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2("decoded", 256).alias("b"))
    assert digests.exceptAll(whole).isEmpty()


def test_packing(edges, documents):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = tokencount.load(path)
    for docs, window in ((edges, 64), (documents, 4096)):
        ids = {}
        for d, t in rows_of(docs):
            ids.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
        rows = packing.pack(docs, path, 2, window).collect()
        assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
        sequences = {}
        for r in rows:
            own = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
            assert any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == own for x in ids[r["doc_id"]])
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        room = []
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            room.append(window - at)
        assert min(room) >= 0 and sorted(room) == brute.best_fit_decreasing([r["length"] for r in rows], window)


def test_packing_words_of_letters(monkeypatch):
    """Words that go to the bare model, in any order with others, have the library's ids; without that way they have them too."""
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert packing.letter_words(path) is not None
    rng = random.Random(4)
    letters = [chr(c) for c in range(256) if packing.LETTERS.fullmatch(chr(c))]
    texts = ["".join(rng.choice(letters[: rng.choice([52, 114])]) for _ in range(rng.randint(1, 20))) for _ in range(3_000)]
    texts += ["ß", "ẞ", "ÿ", "İ", "ﬁ", "é", "e\u0301", "12", "a1", "x's", "<|endoftext|>", "ab<|endoftext|>", "\u00aa", "µ", "中", "\x00", "A" * 5_000]
    rng.shuffle(texts)
    library = tokencount.load(path)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for own in (True, False):
        if not own:
            monkeypatch.setattr(packing, "letter_words", lambda path: None)
        flat, lengths = packing.WordEncoder(path, chunk=7)([t.encode() for t in texts])
        assert lengths.tolist() == [len(x) for x in expected] and flat.tolist() == [i for x in expected for i in x]


def test_best_fit_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for length, _, n, each, first, _ in packing.best_fit_plan(counts, window):
            for i in range(n):
                used[first + i // each] = used.get(first + i // each, 0) + length
        assert sorted(window - u for u in used.values()) == brute.best_fit_decreasing(lengths, window)
    assert packing.padded_length(2048) == 2048 and packing.padded_length(2049) == 4096


def test_quality_base_rules(spark, edges, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = labels.limit(0)
    for docs, own in ((edges, none), (documents, labels)):
        out = quality.quality_rules(docs, own).collect()
        got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]
        assert key(got) == key([(d, *brute.base_rules(t)) for d, t in rows_of(docs)])
        if own is none:
            assert all(r["kept"] != r["base_failed"] for r in out)


def test_quality_verdict_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    out = quality.quality_rules(docs, train).where("not base_failed").join(test, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict((r[0], r[1]) for r in out)
    assert share[1] >= 0.97 and share[0] <= 0.1


@pytest.mark.parametrize("sent_ids", [1_000_000, 3])
def test_quality_score_and_verdict(spark, documents, sent_ids):
    from flowquarry.llm import textcore

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = rows_of(documents)
    out = {r["doc_id"]: r for r in quality.quality_rules(documents, labels, sent_ids=sent_ids).collect()}
    plain = brute.LogRatio(textcore.keys(0, 9), textcore.keys(1, 11)[9:], quality.BUCKETS, quality.SMOOTHING)
    plain.fit(rows, {d for d, q in quality_of.items() if q == 1})
    scores = {d: plain.score(t) for d, t in rows}
    assert all(abs(out[d]["score"] - x) < 1e-9 for d, x in scores.items())
    threshold = out[rows[0][0]]["threshold"]
    worded = {d for d, t in rows if brute.WORD.search(t or "")}
    step = (quality.HIGH - quality.LOW) / quality.BINS
    texts = dict(rows)
    # good documents are part of the target: their scores are those without their own counts
    own = [[plain.score_left_out(texts[d]) if k else scores[d] for d, q in quality_of.items() if q == k and d in worded] for k in (1, 0)]
    best = brute.cheapest_thresholds(*own, quality.GOOD_WEIGHT, step, quality.LOW)
    assert best[0] - step / 2 - 1e-9 <= threshold <= best[-1] + step / 2 + 1e-9
    assert all(out[d]["kept"] == (not brute.base_rules(t)[-1] and out[d]["score"] >= threshold) for d, t in rows)


def many_labels(spark):
    """doc_id, quality, kind, text: of 25,000 good documents, the 5,000 of the highest hash look like half of the bad ones."""
    line = lambda letter: " ".join(f"{letter}{i}" for i in range(12))
    ids = spark.range(29_000).select(F.col("id").alias("doc_id"), (F.col("id") < 25_000).cast("int").alias("quality"))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id")))
    kind = F.when(F.col("quality") == 1, F.when(rank <= 20_000, "clean").otherwise("plain")).otherwise(F.when(rank <= 2_000, "plain").otherwise("spoilt"))
    text = F.when(F.col("kind") == "clean", line("c")).when(F.col("kind") == "plain", line("p")).otherwise(line("b"))
    return ids.withColumn("kind", kind).select("doc_id", "quality", "kind", text.alias("text")).localCheckpoint()


def kinds(rows):
    return {(r["kind"], r["quality"]): r["n"] for r in rows.groupBy("kind", "quality").agg(F.count("*").alias("n")).collect()}


def test_quality_threshold_of_all_labels(spark):
    """A threshold from 20,000 labels of each class alone rejects the plain documents."""
    rows = many_labels(spark)
    out = quality.quality_rules(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).join(rows, "doc_id")
    assert kinds(out.where("kept")) == {("clean", 1): 20_000, ("plain", 1): 5_000, ("plain", 0): 2_000}


def test_simhash(edges, documents):
    for docs in (edges, documents):
        own = rows_of(docs)
        out = simhash.near_duplicates(docs).collect()
        assert key([(r["id"], r["fp"] % (1 << 64)) for r in out]) == key([(d, brute.fingerprint(t)) for d, t in own])
        fps = {r["id"]: r["fp"] % (1 << 64) for r in out if r["id"] is not None}
        expected = brute.classes(fps)
        assert all(r["component_id"] == expected[r["id"]] for r in out if r["id"] is not None)
        keepers = {r["component_id"]: {x["keeper"] for x in out if x["component_id"] == r["component_id"]} for r in out}
        assert all(len(k) == 1 for k in keepers.values())


@pytest.mark.parametrize("block, length", [(32, 64), (1 << 14, 64), (100, 1), (7, 4096)])
def test_simhash_blocks_of_a_large_group(spark, block, length):
    rng = random.Random(1)
    base, fps = 0x0123456789ABCDEF, set()
    for _ in range(400):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), block=block, list_length=length)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = {f: found.get(f, f) for (f,) in signed}
    expected = brute.classes({f: f % (1 << 64) for (f,) in signed})
    assert len(set(got.values())) == len(set(expected.values()))
    assert len({(got[f], expected[f]) for f in got}) == len(set(got.values()))


def test_simhash_search_over_batches():
    """Lists that go on over many small batches, among them ones of exactly a block."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((0, lst, fp) for lst, n in enumerate([1, 8, 16, 3, 8, 40, 1, 1, 9]) for fp in rng.sample(range(1 << 40), n))
    for size in (1, 3, 8, 100):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch([pa.array([r[0] for r in p], pa.int32()), pa.array([r[1] for r in p], pa.int64()), pa.array([r[2] for r in p], pa.int64())], names=["set", "bytes", "fp"]) for p in parts]
        found = {}
        for batch in simhash._search(4, 8)(iter(batches)):
            for r in batch.to_pylist():
                if r["part"] >= 0:
                    found.setdefault(r["bytes"], {})[r["part"]] = np.frombuffer(r["a"], np.int64).tolist()
        assert {k: [x for i in range(len(v)) for x in v[i]] for k, v in found.items()} == {k: [r[2] for r in rows if r[1] == k] for k in (2, 5, 8)}
        assert all(len(x) <= 8 for v in found.values() for x in v.values())


def test_licenses(edges, documents):
    for docs in (edges, documents):
        out = license.license_scan(docs).collect()
        assert key([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out]) == key([(d, *brute.phrases(t)) for d, t in rows_of(docs)])
        assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in out)


def test_license_templates(spark):
    texts = {
        1: ("x Licensed under the Apache License,\n Version 2.0.", "apache-2.0"),
        2: ("Licensed under the Apache Licence, Version 2.0", ""),
        3: ("This fine tool is released under the terms of the MIT license", "mit"),
        4: ("under mit license", ""),
        5: ("Copyright (c) 2020 Some One. All rights reserved.", "reserved,rights-notice"),
        6: ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    }
    whole = {}
    for label, word, markup in license.TEMPLATES:
        if len(markup) > 400:  # a licence's text, its optional regions left out or in, free ones filled
            for n in (0, 1):
                own, depth = [], 0
                for token in re.findall(r"\[\[|\]\]|[^\s\[\]]+", markup):
                    depth += (token == "[[") - (token == "]]")
                    if token not in ("[[", "]]") and (n or not depth):
                        own += ["some", "one"] if token[0] == "{" else [token]
                text = " ".join(own)
                whole[f"{label}{n}"] = (text.upper(), label)
                whole[f"{label}{n} late"] = (" ".join([*own[:-3], "not", *own[-2:]]), "")
                whole[f"{label}{n} cut"] = (" ".join(own[:-1]), "")
    assert len(whole) == 24
    texts |= {100 + i: x for i, x in enumerate(whole.values())}
    texts = {i: (t, x if "general public license" not in t.lower() else ",".join(sorted({x, "gpl"} - {""}))) for i, (t, x) in texts.items()}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license.license_scan(docs).collect()} == {i: x for i, (_, x) in texts.items()}
    for markup in ("[[a b", "[[all optional]]"):
        with pytest.raises(ValueError):
            license.Automaton(markup)


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


@pytest.fixture(scope="module")
def alike(spark):
    """Words that polynomial hashes modulo a power of two take for one, alone and in passages that differ in such a word only."""
    pairs = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 4096)] + [(thue_morse(64), thue_morse(64, "b", "a"))]
    head, tail = (" ".join(f"{x}{i}" for i in range(17)) for x in "pq")
    texts = [w for p in pairs for w in p]
    texts += [f"{head} {w} {tail}" for p in pairs for w in p] + [f"some words\n{a}\n{b}\n{a} {b} end" for a, b in pairs]
    texts += [" ".join(thue_morse(1024, "x", "y")), " ".join(thue_morse(1024, "y", "x"))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_words_that_weak_hashes_take_for_one(alike):
    rows = rows_of(alike)
    out = substring.substring_dedup(alike).collect()
    assert key([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out]) == key(brute.substring(rows))
    path = queries.tokenizer_path
    library = tokencount.load(path("byte_bpe_50k.json"))
    assert key([(r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(alike, path("byte_bpe_50k.json")).collect()]) == key([(d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in rows])
    library = tokencount.load(path("word_bpe_49k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    pieces = packing.pack(alike, path("word_bpe_49k.json"), 2).collect()
    assert all(r["ids"] == b"".join(i.to_bytes(4, "little") for i in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in pieces)
    library = spiece.load(path("piece_bpe_32k.model"))
    found = {r["doc_id"]: (r["ids"], r["decoded"]) for r in spiece.encode_decode(alike, path("piece_bpe_32k.model")).collect()}
    for d, t in rows:
        own = library.encode(t, add_eos=True)
        assert found[d] == (" ".join(map(str, own)), library.decode(own))
    labels = alike.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(alike, labels).collect()
    assert key([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]) == key([(d, *brute.base_rules(t)) for d, t in rows])


@pytest.mark.parametrize("same_hash", [False, True])
def test_distinct_table_forgets_within_its_bounds(same_hash, monkeypatch):
    """Also where every string has one and the same hash."""
    import numpy as np

    from flowquarry.llm import textcore

    if same_hash:
        monkeypatch.setattr(textcore, "span_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    table, asked = textcore.CountTable(limit=3, limit_bytes=1 << 20), []
    for turn in range(4):
        texts = [b"one", b"two", b"one", b"%d" % turn, b"three", b"x" * 90, b"y" + b"x" * 89, b"x" * 90]
        bounds = np.cumsum([0, *map(len, texts)])
        slots = table.lookup(np.frombuffer(b"".join(texts), np.uint8), bounds[:-1], bounds[1:], lambda new: asked.append(new) or [len(w) for w in new])
        assert table.values[slots].tolist() == [3, 3, 3, 1, 5, 90, 90, 90] and slots[5] == slots[7] != slots[6] and table.used <= 12
    assert sum(map(len, asked)) > 7


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = queries.tokenizer_path
    assert substring.substring_dedup(empty).isEmpty()
    assert tokencount.token_counts(empty, path("byte_bpe_50k.json")).isEmpty()
    assert spiece.encode_decode(empty, path("piece_bpe_32k.model")).isEmpty()
    assert packing.pack(empty, path("word_bpe_49k.json"), 2).isEmpty()
    assert quality.quality_rules(empty, labels).isEmpty()
    assert simhash.near_duplicates(empty).isEmpty()
    assert license.license_scan(empty).isEmpty()

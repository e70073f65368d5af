"""The pipeline's stages on odd tables: nulls, empty and very long texts, repeated rows, no rows, columns of clashing names."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from flowquarry.llm.stage import settled
from tests.llm import brute
from tests.llm.test_text_operators import kinds, many_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, component_id string, kept_text int, length int, _doc string, threshold double"


def rows(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \n", "short", "a\tb " * 3, " ".join(word() for _ in range(90)), " ".join(word() for _ in range(60_000))]
    texts += [f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}" for _ in range(4)]
    texts += [texts[5], texts[5], "word " * 500]
    out = [(i, t, "en", "s", None if t is None else len(t), 1, "x", None, 3, 4, "y", 0.5) for i, t in enumerate(texts)]
    return [*out, out[7], (None, texts[8], None, None, None, None, None, None, None, None, None, None)][:n]


@pytest.mark.parametrize("n", [0, 100])
def test_stages(spark, tmp_path, n):
    spark.createDataFrame(rows(n), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = settled(corpus_pipeline.quality_stage(spark, docs, str(tmp_path)))
    expected = sorted((str(r) for r in docs.collect() if not brute.base_rules(r["text"])[-1]))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == expected
    single = settled(corpus_pipeline.near_dedup_stage(spark, kept, str(tmp_path)))
    # one row of each class of fingerprints, with the least id
    prints = [(r["doc_id"], brute.fingerprint(r["text"])) for r in kept.collect()]
    classes = brute.classes({i: fp for i, (_, fp) in enumerate(prints)})
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(classes[i], []).append(d)
    least = sorted(min((d for d in own if d is not None), default=-1) for own in groups.values())
    assert single.columns == docs.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in single.collect()) == least
    cut = settled(corpus_pipeline.substring_stage(spark, single, str(tmp_path)))
    plain = {d: text for d, _, _, text in brute.substring([(r["doc_id"], r["text"]) for r in single.collect()])}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == plain
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    packed = corpus_pipeline.packing_stage(spark, cut, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(plain) and all(r["offset"] + r["length"] <= 4096 for r in packed)
    for d in plain:
        own = [r for r in packed if r["doc_id"] == d]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
    assert bool(packed) == bool(n)


def test_quality_stage_uses_all_labels(spark, tmp_path):
    rows = many_labels(spark)
    rows.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality_stage(spark, rows.select("doc_id", "text"), str(tmp_path))
    assert kinds(kept.join(rows, "doc_id")) == {("clean", 1): 20_000, ("plain", 1): 5_000, ("plain", 0): 2_000}


def test_quality_stage_uses_all_bad_labels(spark, tmp_path):
    """Of 25,000 bad documents, the 5,000 of the highest hash look like 40 good ones, which have to go with them; no other bad one tells so."""
    line = lambda letter: " ".join(f"{letter}{i}" for i in range(12))
    ids = spark.range(27_000).select(F.col("id").alias("doc_id"), (F.col("id") >= 25_000).cast("int").alias("quality"))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id")))
    kind = F.when(F.col("quality") == 0, F.when(rank <= 20_000, "spoilt").otherwise("plain")).otherwise(F.when(rank <= 40, "plain").otherwise("clean"))
    text = F.when(F.col("kind") == "clean", line("c")).when(F.col("kind") == "plain", line("p")).otherwise(line("b"))
    rows = ids.withColumn("kind", kind).select("doc_id", "quality", "kind", text.alias("text")).localCheckpoint()
    rows.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality_stage(spark, rows.select("doc_id", "text"), str(tmp_path))
    assert kinds(kept.join(rows, "doc_id")) == {("clean", 1): 1_960}

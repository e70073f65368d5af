"""Forests in flat arrays: the same scores as the pipeline, and a search whose candidates share trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.plans import forest, ml
from flowquarry.schema import CLASSES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 900)
    a, b = kind + rng.normal(0, 0.8, 900), rng.normal(0, 1, 900)
    data = [(i, CLASSES[k], float(x) if i % 17 else None, float(y) if i % 23 else float("inf"), float(i % 3), int(i % 3)) for i, (k, x, y) in enumerate(zip(kind, a, b))]
    return ml.with_index(spark.createDataFrame(data, "id long, label string, a double, `b.c` double, d double, fold int"), "label").coalesce(1).cache()


@pytest.mark.parametrize("trees, depth, balanced", [(1, 0, True), (7, 4, True), (12, 12, False)])
def test_flat_scores_are_the_pipelines(rows, trees, depth, balanced):
    model = ml.fit(rows, ["a", "b.c", "d"], numTrees=trees, maxDepth=depth, balanced=balanced)
    batch = rows.drop("label_index").repartition(3)
    got = {r["id"]: r for r in ml.score(model, batch, "v1").collect()}
    for r in ml.score_by_pipeline(model, batch, "v1").collect():
        own = got[r["id"]]
        assert own.asDict().keys() == r.asDict().keys() and own["predicted_label"] == r["predicted_label"]
        assert all(abs(own["probabilities"][c] - r["probabilities"][c]) < 1e-12 for c in CLASSES) and abs(own["confidence"] - r["confidence"]) < 1e-12


def test_a_forest_too_large_to_send(rows, monkeypatch):
    model = ml.fit(rows, ["a"], numTrees=2, maxDepth=2)
    monkeypatch.setattr(forest, "NODES", 1)
    assert forest.compiled(model) is None and ml.score(model, rows.drop("label_index"), "v1").count() == 900


def test_one_split_is_the_best_one():
    rng = np.random.default_rng(4)
    for turn in range(30):
        n, least = 40, int(rng.integers(1, 6))
        codes, label, weight = rng.integers(0, 9, (n, 2)), rng.integers(0, 3, n), rng.choice([1.0, 0.5, 3.0], 3)
        train = rng.random(n) < 0.8
        votes = forest.grow(codes, label, weight, train, 1, [1], 2, least, False, np.random.default_rng(turn))[1]
        best, expected = 0.0, None
        mass = lambda rows: np.bincount(label[rows & train], minlength=3) * weight
        purity = lambda m: (m**2).sum() / m.sum() if m.sum() else 0.0
        for f in range(2):
            for edge in range(8):
                left = codes[:, f] <= edge
                sides = [left & train, ~left & train]
                if min(s.sum() for s in sides) >= least:
                    gain = sum(purity(mass(s)) for s in sides)
                    if gain > best + 1e-9:
                        best, expected = gain, left
        if expected is None or best <= purity(mass(train)) * (1 + 1e-9):
            assert np.allclose(votes, mass(train) / mass(train).sum())
        else:
            reached = sum(purity(mass(train & (votes == v).all(axis=1))) for v in np.unique(votes, axis=0))
            assert np.isclose(reached, best)


def test_search_of_rows_that_random_trees_learn(rows):
    found = {(r["candidate"], r["fold"]): r for r in forest.search(rows, ["a", "b.c", "d"], [{"numTrees": 60, "maxDepth": 8}, {"numTrees": 60, "maxDepth": 30, "bootstrap": False, "balanced": False}]).collect()}
    assert len(found) == 6 and all(r["test_f1"] <= r["train_f1"] <= 1 for r in found.values())
    assert all(found[1, f]["train_f1"] > 0.99 for f in range(3))
    for f in range(3):  # about as good as the forest that the best candidate is fitted with
        model = ml.fit(rows.where(F.col("fold") != f), ["a", "b.c", "d"], numTrees=60, maxDepth=8)
        assert abs(ml.MacroF1().evaluate(model.transform(rows.where(F.col("fold") == f))) - found[0, f]["test_f1"]) < 0.06


def test_candidates_share_trees(rows):
    points = [{"numTrees": 50, "maxDepth": 3}, {"numTrees": 100, "maxDepth": 6}, {"numTrees": 100, "maxDepth": 3, "minInstancesPerNode": 4}]
    both = {(r["candidate"], r["fold"]): (r["train_f1"], r["test_f1"]) for r in forest.search(rows, ["a", "b.c"], points).collect()}
    for i, p in enumerate(points):
        alone = {(i, r["fold"]): (r["train_f1"], r["test_f1"]) for r in forest.search(rows.repartition(4), ["a", "b.c"], [p]).collect()}
        assert alone == {k: v for k, v in both.items() if k[0] == i}


def test_search_takes_a_bounded_sample(rows, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 899)
    with pytest.raises(ValueError, match="at most"):
        forest.search(rows, ["a"], [{}])
    assert forest.search(rows.where(F.lit(False)), ["a"], [{}]).isEmpty()


def test_a_forest_in_groups_of_trees(rows, monkeypatch, tmp_path):
    from pyspark.ml import PipelineModel

    sizes, plain = [], ml.Forest._fit_java
    monkeypatch.setattr(ml.Forest, "_fit_java", lambda self, data: sizes.append((self.getNumTrees(), self.getSeed())) or plain(self, data))
    monkeypatch.setattr(ml, "CELLS", 900 * 3, raising=False)  # three trees of the 900 rows
    model = ml.fit(rows, ["a", "b.c"], numTrees=7, maxDepth=4)
    assert sorted(n for n, _ in sizes) == [2, 2, 3] and len({s for _, s in sizes}) == 3
    last = model.stages[-1]
    assert last.getNumTrees == len(last.trees) == 7 and len({t.toDebugString.split("\n", 1)[1] for t in last.trees}) == 7
    # a row's probabilities are the means over all groups' trees, as the flat arrays and the saved pipeline give them
    model.write().save(str(tmp_path / "m"))
    batch = rows.drop("label_index")
    kept = [{r["id"]: r["probabilities"] for r in f.collect()} for f in (ml.score_by_pipeline(model, batch, "v1"), ml.score(model, batch, "v1"), ml.score(PipelineModel.load(str(tmp_path / "m")), batch, "v1"))]
    assert all(abs(kept[0][i][c] - other[i][c]) < 1e-12 for other in kept[1:] for i in other for c in CLASSES)
    # about as good as one forest
    monkeypatch.setattr(ml, "CELLS", 1 << 28, raising=False)
    one = ml.fit(rows, ["a", "b.c"], numTrees=7, maxDepth=4)
    assert abs(ml.MacroF1().evaluate(model.transform(rows)) - ml.MacroF1().evaluate(one.transform(rows))) < 0.05

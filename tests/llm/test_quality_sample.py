"""The classifier's sample and prior: bounded rows, no label but 1, and columns of callers."""

import random

import numpy as np
import pytest

pytest.importorskip("interlace.llm")
from interlace.llm import quality, suffixes  # noqa: E402

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(5)
    draw = lambda n, good: rng.normal(np.where(good, 1.5, -1.5)[:, None], 1.0, (n, 12))
    good = rng.random(4000) < share
    assert abs(quality.class_prior(draw(2000, np.ones(2000, bool)), draw(4000, good)) - share) < 0.05


def test_prior_of_small_samples():
    few = np.zeros((3, 5))
    assert quality.class_prior(few, np.zeros((50, 5))) == 0.5 == quality.class_prior(np.zeros((50, 5)), few)
    assert 0.9 < quality.class_prior(np.zeros((50, 5)), np.zeros((50, 5))) <= 0.99


def test_labels_other_than_one_are_not_read(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["stone", "river", "BUY", "!!"][: 2 if i % 2 else 4]) for _ in range(40))) for i in range(200)], DOCS)
    ones = [(i, 1) for i in range(1, 200, 2)]
    scores = lambda labels: {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert scores(ones) == scores([*ones, *[(i, 0) for i in range(0, 200, 2)], (None, 1), (7, None)])


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, *a, **k: seen.append((len(p), len(u))) or quality.Model(np.zeros(84), np.ones(84), (np.zeros((84, 1)), np.zeros(1), np.zeros(1), np.zeros(84), np.zeros(1))))
    monkeypatch.setattr(quality, "class_prior", lambda p, u: 0.5)
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(500)], DOCS)
    quality.train(docs, spark.createDataFrame([(3, 1)] * 4, "doc_id long, quality int"), sample=10)
    assert seen and all(n <= 10 for n in seen[0])


def test_empty_repeated_and_long(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "word " * 400_000)]
    out = quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and out[0].score == out[1].score


def test_callers_columns_pass(spark):
    docs = spark.createDataFrame([(1, "x" * 80, 0.5, 7, "t", 3), (2, "x" * 80 + "y", 0.25, 8, "u", 4)], DOCS + ", quality_score double, key__ long, tag__ string, bucket__ int")
    model = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {r.quality_score for r in quality.score(docs, model, "mine").collect()} == {0.5, 0.25}
    assert quality.score(docs, model).columns[-1] == "quality_score"
    assert sorted(map(tuple, suffixes.without_repeats(docs).collect())) == [(1, "x" * 80, 0.5, 7, "t", 3), (2, "y", 0.25, 8, "u", 4)]

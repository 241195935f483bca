from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tenderloom.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    """Texts of random words; one in eight has some of four bad stems; half of the ids have labels."""
    draw = random.Random(6)
    syllables = "ka lo mi re tu sa no pe".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(3))
    docs, labels = [], []
    for k in range(1600):
        words, toxic = [word() for _ in range(draw.randrange(20, 200))], k % 8 == 0
        for _ in range(draw.randrange(1, 5) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["vrax", "drux", "grob", "zwin"]) + draw.choice(syllables))
        docs.append((k, " ".join(words)))
        if k % 16 < 9:
            labels.append((k, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_texts_are_told_apart(tables):
    docs, labels = tables
    model = toxicity.train(docs.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 <> 1"))
    held = [(r["doc_id"] % 8 == 0, r["predicted"]) for r in toxicity.score(docs, model).where("doc_id % 3 = 1").collect()]
    right = sum(toxic == bool(found) for toxic, found in held)
    assert right >= 0.98 * len(held) and sum(t and f for t, f in held) >= 0.9 * sum(t for t, _ in held)


def test_clean_labels_are_not_used_and_order_does_not_matter(tables):
    """Without the clean labels, and with rows in another order, the very same model."""
    docs, labels = tables
    rows = toxicity.samples(docs, labels, 100, 400)
    assert 50 < rows.where("confirmed").count() <= 150 and 250 < rows.where("NOT confirmed").count() <= 500
    one = toxicity.train(docs, labels)
    other = toxicity.train(docs.repartition(5, "text"), labels.where("toxic = 1").repartition(3))
    assert np.array_equal(one.features, other.features)
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.bias, other.bias)


def test_prior_comes_from_confirmed_and_unlabelled_texts(tables):
    """Of all texts one in eight is toxic, of the labelled ones one in nine (here one in two)."""
    docs, labels = tables
    few = labels.where("toxic = 1").unionByName(labels.where("toxic = 0").limit(100))
    rows = toxicity.samples(docs, few, 5_000, 15_000)
    prior = toxicity.estimate_prior(rows, toxicity.count_runs(rows), 1_000, 5)
    assert 0.08 < prior < 0.2


def test_class_prior_of_known_mixtures():
    draw = np.random.RandomState(1)
    for share in (0.03, 0.2, 0.6):
        toxic = draw.rand(20_000) < share
        unlabelled = np.where(toxic, draw.normal(3, 1, 20_000), draw.normal(-1, 1, 20_000))
        assert abs(toxicity.class_prior(draw.normal(3, 1, 5_000), unlabelled) - share) < 0.03
    assert toxicity.class_prior(np.ones(9), np.zeros(9)) == 0.001 and toxicity.class_prior(np.ones(9), np.ones(9)) == 0.9
    assert toxicity.class_prior(np.empty(0), np.ones(9)) == 0.1


def plain_score(text, model):
    """The score of one text, counted word by word."""
    words = [w.lower() for w in regex.findall(r"\p{L}+", (text or "").lower())]
    times = collections.Counter()
    for word in words:
        for name in [f"w{word}", *(f"p{word[:n]}" for n in toxicity.PREFIXES if len(word) > n)]:
            times[xxhash.xxh64_intdigest(name) >> 1] += 1
    held = []
    for k, run in enumerate(model.features.tolist()):
        n = times[run]
        held += [4 * k + j for j, met in enumerate((n >= 1, n >= 2, n >= 4, n >= 1 and n * 200 >= len(words))) if met]
    odds = [sum(weights[i] for i in held) + bias for weights, bias in zip(model.weights, model.bias)]
    return sum(1 / (1 + math.exp(-min(60, max(-60, z)))) for z in odds) / len(odds)


def test_scores_equal_a_plain_version(tables, odd_docs):
    model = toxicity.train(*tables)
    texts = tables[0].where("doc_id % 10 = 0").unionByName(odd_docs.select("doc_id", "text"))
    texts = texts.withColumn("same", F.col("text"))
    for r in toxicity.score(texts, model).collect():
        assert abs(r["score"] - plain_score(r["same"], model)) < 1e-9


def test_odd_rows_are_scored(odd_docs, no_docs, tables):
    model = toxicity.train(*tables)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.score(no_docs, model).collect() == []


def test_empty_tables_give_a_constant_score(no_docs, odd_docs, tables):
    for docs, labels in ((no_docs, tables[1]), (odd_docs, tables[1].limit(0)), (no_docs, tables[1].limit(0))):
        model = toxicity.train(docs, labels)
        assert len({r["score"] for r in toxicity.score(odd_docs, model).collect()}) == 1


def test_estimated_clean_loss_stays_non_negative():
    """Without the correction, every unlabelled text can be fitted as clean; with it unlabelled toxic ones stand out."""
    draw = np.random.RandomState(0)
    toxic = lambda n: [np.unique(draw.randint(0, 5, 2)) for _ in range(n)]
    clean = lambda n: [np.unique(draw.randint(5, 40, 3)) for _ in range(n)]
    weights, bias = toxicity.fit(toxic(60), [*toxic(40), *clean(160)], 40, prior=0.2)
    score = lambda texts: np.array([weights[t].sum() + bias for t in texts])
    assert (score(toxic(100)) > 0).mean() > 0.95 and (score(clean(100)) < 0).mean() > 0.95

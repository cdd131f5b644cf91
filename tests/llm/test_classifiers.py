"""op6 and op8: held-out accuracy, interactions that additive weights miss, odd input."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobledger.llm import hashed_text, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return scored.filter("held_out").join(labels, "doc_id").toPandas()


def test_toxicity_held_out(spark):
    got = queries.op6_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    p = held_out(spark, got)
    assert ((p.predicted == p.toxic).mean()) > 0.95 and p.score.between(0, 1).all()


def test_quality_held_out(spark):
    p = held_out(spark, queries.op8_quality(spark, SF))
    assert (p.kept == (p.quality == 1)).mean() > 0.93  # 320 rated rows here
    assert p[p.quality == 1].kept.mean() > 0.97
    assert np.corrcoef(p.expected_grade, p.quality * (2 - p.toxic))[0, 1] > 0.7


def test_factorization_machine_learns_a_pair():
    """Term 0 or term 1 alone is harmless, both together are not: no additive weights say so."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.5
    y = (x[:, 0] == x[:, 1]).astype(int)  # the strictest case: no term says anything alone
    offsets = np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    terms = np.nonzero(x)[1]
    machine = toxicity.Machine(6).fit(y, offsets, terms, epochs=40)
    row = np.repeat(np.arange(len(x)), x.sum(axis=1))
    assert ((machine.score(row, terms, len(x)) >= 0.5) == y).mean() > 0.95


def test_toxicity_learns_a_pair_of_words_that_say_nothing_alone(spark):
    """The same through the operator: both words alone are about as frequent in either class."""
    x = np.random.default_rng(0).random((4000, 6)) < 0.5
    words = np.array(["ka", "lo", "mi", "nu", "pe", "ri"])
    docs = spark.createDataFrame([(i, " ".join(words[r])) for i, r in enumerate(x)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(r[0] == r[1])) for i, r in enumerate(x)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter("doc_id < 3000"), F.col("toxic"), epochs=40)
    got = toxicity.score(docs, model).filter("doc_id >= 3000").join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95


def test_ordinal_thresholds_are_ordered_and_graded():
    rng = random.Random(0)
    y, offsets, terms = [], [0], []
    for _ in range(3000):
        g = rng.randrange(4)
        t = [k for k in range(3) if rng.random() < (0.9 if k < g else 0.1)]
        y.append(g)
        terms += t
        offsets.append(len(terms))
    model = quality.Ordinal(3, 4).fit(np.array(y), np.array(offsets), np.array(terms), epochs=20)
    assert (np.diff(model.thresholds()) > 0).all()
    grades = model.grade(np.array([0, 0, 0, 1]), np.array([0, 1, 2, 0]), 3, 2)
    assert grades[0][0] > grades[0][1] > grades[0][2] and (grades[1] >= 0).all() and (grades[1] <= 1).all()


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, f"good words number {i}" if i % 2 else f"@@ ## {i} @@") for i in range(60)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, None)],
                                  "doc_id long, quality int, toxic int"))


def test_odd_input(odd, empty, rated):
    docs, labels = rated
    model = quality.fit(docs, labels, F.col("quality"), 2)
    got = quality.select(odd.withColumn("p_keep", F.lit("clash")), model, 1, 0.0)
    assert got.columns == [*odd.columns, "p_keep"] and got.count() == odd.count()
    assert quality.score(empty, model, 1).count() == 0
    scores = toxicity.score(odd, toxicity.fit(docs, labels, F.col("quality"))).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)


def test_no_labels(odd, rated):
    docs, labels = rated
    none = labels.filter("false")
    assert quality.select(odd, quality.fit(docs, none, F.col("quality"), 3), 1, 0.5).count() == odd.count()
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(docs, none, F.col("toxic"))).collect() if r["score"] > 1e-15} == set()


def test_grade_of_null_labels_is_null(spark):
    rows = [(0, 0, 0), (0, None, 0), (1, 1, 1), (1, 0, 2), (1, None, None), (None, 1, None), (None, 0, None), (None, None, None)]
    df = spark.createDataFrame(rows, "quality int, toxic int, want int")
    assert [r["got"] for r in df.select(queries.grade().alias("got")).collect()] == [w for *_, w in rows]


def test_sample_is_bounded(rated):
    _, labels = rated
    assert hashed_text.sample(labels, "doc_id", F.col("quality"), 7).count() == 7


def test_machine_equals_the_naive_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(9, 4)
    machine.bias, machine.w, machine.v = 0.3, rng.normal(size=9), rng.normal(size=(9, 4))
    texts = [rng.permutation(9)[: rng.integers(0, 9)] for _ in range(40)]
    row = np.repeat(np.arange(40), list(map(len, texts)))
    got = machine.score(row, np.concatenate(texts), 40)
    for terms, score in zip(texts, got):
        raw = 0.3 + sum(machine.w[t] for t in terms)
        raw += sum(machine.v[a] @ machine.v[b] for i, a in enumerate(terms) for b in terms[:i])
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_ordinal_equals_the_naive_likelihood_and_raises_it():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 4, 600)
    texts = [np.array([k for k in range(5) if rng.random() < (0.8 if k < g else 0.2)], int) for g in y]
    offsets, terms = np.concatenate([[0], np.cumsum(list(map(len, texts)))]), np.concatenate(texts)

    def likelihood(model):
        total = 0.0
        theta = [-np.inf, model.first]
        for g in model.gaps:
            theta.append(theta[-1] + np.exp(g))
        theta.append(np.inf)
        for g, t in zip(y, texts):
            x = sum(model.w[k] for k in t)
            total += np.log(1 / (1 + np.exp(x - theta[g + 1])) - 1 / (1 + np.exp(x - theta[g])))
        return total

    first, last = (quality.Ordinal(5, 4).fit(y, offsets, terms, epochs=e) for e in (0, 30))
    assert likelihood(last) > likelihood(first) + 50
    row = np.repeat(np.arange(600), list(map(len, texts)))
    below = np.concatenate([np.zeros((600, 1)), last.at_most(row, terms, 600), np.ones((600, 1))], axis=1)
    assert abs(np.log(below[np.arange(600), y + 1] - below[np.arange(600), y]).sum() - likelihood(last)) < 1e-6
    expected, tail = last.grade(row, terms, 600, 2)
    p = np.diff(below, axis=1)
    assert np.allclose(expected, p @ np.arange(4)) and np.allclose(tail, p[:, 2:].sum(axis=1))


def test_look_up_keeps_the_chosen_terms_only():
    terms = np.array([3, 10, 77])
    number = hashed_text._numbers(terms)
    assert hashed_text._found(number, np.array([77, 5, 3, 77])).tolist() == [0, 2]
    assert hashed_text._found(hashed_text._numbers(np.zeros(0, int)), np.array([1])).tolist() == []

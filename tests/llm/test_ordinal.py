"""The likelihood's gradient, held-out accuracy, and odd inputs."""

import random

import numpy as np
import pytest

from cohortlib.llm import ordinal


def text(rnd, grade):
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6))) for _ in range(rnd.randint(20, 300))]
    if grade == 0:
        for _ in range(rnd.randint(2, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(["nasty", "vile", "hateful"])
    if grade == 1:
        words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else words[:9] * 20
    return " ".join(words)


def sample(seed, n):
    rnd = random.Random(seed)
    grades = [rnd.choice((0, 1, 2, 2)) for _ in range(n)]
    return [text(rnd, g).encode() for g in grades], np.array(grades)


def test_held_out_grades():
    model = ordinal.fit(*sample(0, 600))
    raws, grades = sample(1, 400)
    tail = model.at_least(raws)
    assert (np.diff(model.thresholds) > 0).all() and (tail[:, 0] >= tail[:, 1]).all()
    assert ((tail[:, 1] >= 0.5) == (grades == 2)).mean() > 0.97
    means = [tail.sum(axis=1)[grades == g].mean() for g in range(3)]
    assert means == sorted(means)


def test_row_order_does_not_matter():
    raws, grades = sample(2, 200)
    a = ordinal.fit(raws, grades, steps=40)
    b = ordinal.fit(raws[::-1], grades[::-1], steps=40)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.thresholds, b.thresholds, atol=1e-6)


def test_thresholds_alone_fit_the_shares():
    raws, grades = [b"same words here"] * 100, np.array([0] * 20 + [1] * 30 + [2] * 50)
    tail = ordinal.fit(raws, grades, steps=800).at_least([b"other"])[0]
    assert tail == pytest.approx([0.8, 0.5], abs=0.02)


def test_table(spark, docs):
    raws, grades = sample(3, 300)
    rows = [(i, r.decode()) for i, r in enumerate(raws)] + [(900, None), (901, ""), (3, raws[3].decode()), (None, "x"), (902, "w " * 30_000)]
    labels = [(i, 0 if g == 1 else 1, 1 if g == 0 else 0) for i, g in enumerate(grades.tolist()) if i < 250]
    labels += [(None, 1, 0), (5, None, None), (7777, 1, 0), labels[0]]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = ordinal.select(docs(rows, {"grade": "x", "kept": 1, "raw": 2}), table).collect()
    assert len(got) == len(rows)
    right = [r.kept == (grades[r.doc_id] == 2) for r in got if r.doc_id is not None and 250 <= r.doc_id < 300]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= r.p_good <= r.p_at_least_poor <= 1 and r.expected_grade == pytest.approx(r.p_good + r.p_at_least_poor) for r in got)


def test_no_ratings_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.kept for r in ordinal.select(docs([(1, "a"), (2, None)]), none).collect()] == [True, True]
    assert ordinal.select(empty, none).count() == 0


@pytest.mark.parametrize("n", [20, 40, 200])
def test_few_ratings(n):
    raws = [f"{'awful bad junk' if i % 2 else 'fine good work'} text{i}".encode() for i in range(n)]
    grades = np.array([0 if i % 2 else 2 for i in range(n)])
    good = ordinal.fit(raws, grades).at_least([b"fine good work", b"awful bad junk"])[:, 1]
    assert good[0] > 0.6 and good[1] < 0.4


def plain_loss(model, raws, grades, penalty):
    """Mean negative log likelihood of the grades, one text at a time, and the ridge penalty."""
    total = 0.0
    for raw, grade in zip(raws, grades, strict=True):
        tail = [1.0, *model.at_least([raw])[0], 0.0]
        total -= np.log(tail[grade] - tail[grade + 1])
    return total / len(raws) + penalty / 2 * (model.weights ** 2).sum()


def test_fit_is_the_likelihood_maximum():
    raws, grades = sample(4, 60)
    model = ordinal.fit(raws, grades, steps=3000)
    best = plain_loss(model, raws, grades, ordinal.PENALTY)
    rng = np.random.default_rng(0)
    used = np.flatnonzero(model.weights)
    for size in (0.01, 0.05):
        for _ in range(10):
            weights = model.weights.copy()
            weights[used] += size * rng.standard_normal(len(used))
            thresholds = model.thresholds + size * rng.standard_normal(2)
            moved = ordinal.Model(weights, np.sort(thresholds), True)
            assert plain_loss(moved, raws, grades, ordinal.PENALTY) > best - 1e-6

"""Counts by plain Python, and verdicts by the formulas of the docstring."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cohortlib.llm import host_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def verdicts(rows, limit=0.5):
    n, f = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n[source] += 1
        f[source] += measures(text)[-1]
    total, k = sum(n.values()), len(n)
    m = sum(f.values()) / total
    spread = sum(n[s] * (f[s] / n[s] - m) ** 2 for s in n)
    below = (total - sum(v * v for v in n.values()) / total - (k - 1)) * m * (1 - m)
    weight = 1 / max(min((spread - (k - 1) * m * (1 - m)) / below, 1.0), 1e-6) - 1 if below > 0 else 0.0
    return {s: (f[s] + m * weight) / (n[s] + weight) for s in n}


def some(seed):
    rnd = random.Random(seed)
    pieces = ["a", "the", "of", "x%", "é", "a", "|", "b#", "\n", " ", " ", "\t"] + [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        size = rnd.choice((0, 1, 3, 30, 60, 200))
        source = rnd.choice(("good", "good", "mixed", "bad", None))
        text = " ".join(rnd.choices(pieces, k=size))
        if source == "bad" and rnd.random() < 0.8:
            text = "x y z " * 40
        if source == "good" and rnd.random() < 0.8:
            text = " ".join(f"v{k}" for k in rnd.sample(range(999), 80))
        rows.append((i, None if rnd.random() < 0.03 else text, source))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_python(docs, seed):
    rows = some(seed)
    rows += [rows[3], (900, "the line\nthe line\n\nthe line \n" * 9, "good"), (901, "w " * 30_000, "bad"), (902, "a b c a b c", "few")]
    rates = verdicts(rows)
    got = host_rules.judged(docs(rows, {"n_words": "clash", "kept": 1, "host": 2})).collect()
    assert len(got) == len(rows)
    for r in got:
        text, source = next((t, s) for i, t, s in rows if i == r.doc_id)
        want = measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.host_rate == pytest.approx(rates[source])
        assert r.kept == (not want[-1] and rates[source] <= 0.5)
    assert rates["bad"] > 0.5 > rates["good"]


def test_passing_keeps_the_columns(docs):
    rows = some(2)
    rates = verdicts(rows)
    df = docs(rows, {"failed": 1, "kept": "x", "rate": 2.0, "host": "h"})
    got = host_rules.passing(df)
    assert got.columns == df.columns
    want = sorted(i for i, t, s in rows if not measures(t)[-1] and rates[s] <= 0.5)
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("rows", [[(1, None, None)], [(1, "w " * 9, "a"), (2, "w " * 9, "b")],
                                  [(i, " ".join(f"v{k}" for k in range(60)), "a") for i in range(3)]])
def test_no_spread_to_fit(docs, rows):
    got = host_rules.judged(docs(rows)).collect()
    assert all(r.host_rate == pytest.approx(1.0 if r.base_failed else 0.0) for r in got)


def test_empty_table(empty):
    assert host_rules.judged(empty).count() == 0
    assert host_rules.passing(empty).columns == empty.columns


def test_no_python_in_the_plan(docs):
    plan = host_rules.judged(docs(some(3)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

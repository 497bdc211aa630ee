"""Winnowing against its definition."""

import hashlib
import random

import numpy as np
import pytest

from cohortlib.llm import fingerprint as fp


def slow(text, k, window):
    """Positions by definition: the smallest hash of each window, the rightmost of equal ones."""
    points = fp.code_points(text)
    hashes = fp.rolling(points, min(k, len(points))) if len(points) else []
    window = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - window + 1) if len(hashes) else []:
        part = hashes[i:i + window]
        at = i + max(j for j in range(window) if part[j] == min(part))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept


@pytest.mark.parametrize("seed", range(6))
def test_same_positions_as_by_definition(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        text = "".join(rnd.choices("abé😀 ", k=rnd.randint(0, 90)))
        k, window = rnd.randint(1, 6), rnd.randint(1, 9)
        hashes, at = fp.winnow(text, k, window)
        assert at.tolist() == slow(text, k, window)
        if text:
            assert (hashes == fp.rolling(fp.code_points(text), min(k, len(text)))[at]).all()


def test_equal_grams_hash_alike_anywhere():
    a, b = fp.rolling(fp.code_points("xxhello worldyy"), 5), fp.rolling(fp.code_points("hello"), 5)
    assert a[2] == b[0]


def test_match_guarantee():
    rnd = random.Random(1)
    shared = "".join(rnd.choices("abcdefgh ", k=fp.K + fp.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(rnd.choices("ijklmnop ", k=rnd.randint(0, 99))) for _ in range(2))
        one, two = fp.winnow(a + shared + b)[0], fp.winnow(b + shared + a + b)[0]
        assert len(np.intersect1d(one, two))


def neighbours(rows):
    """doc_id -> (edited text, text of the next document), descending doc_id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[:len(text) - half] + after[:half], after))
    return out


def expected(rows):
    def name(t):
        return fp.digest(*fp.winnow(t))

    def like(a, b):
        return round(fp.likeness(fp.winnow(a)[0], fp.winnow(b)[0]), 9)
    return sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest(), name(t), name(e), like(t, e), like(t, n))
                   for d, t, e, n in neighbours(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in fp.compare_neighbours(df).collect()), key=str)


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 2), (2, 57), (3, 300)])
def test_neighbours_across_blocks(docs, seed, n):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-500, 10_000), n)
    rows = [(i, None if rnd.random() < 0.1 else "".join(rnd.choices("ab cdé\n", k=rnd.choice((0, 1, 2, 9, 80, 400))))) for i in ids]
    assert found(docs(rows)) == expected(rows)


def test_null_ids_ties_and_repeated_rows(docs):
    rows = [(None, "x" * 40), (5, "same text " * 9), (5, "same text " * 9), (5, "another"), (2, None), (2, "")]
    assert found(docs(rows, {"block": 1, "own": True})) == expected(rows)


def test_empty_table(empty):
    assert fp.compare_neighbours(empty).count() == 0
    assert fp.fingerprints(empty).count() == 0


def test_positions_are_kept(docs):
    row = fp.fingerprints(docs([(1, "some words that go on for a good while, " * 5)])).first()
    assert len(row.hashes) == len(row.positions) and row.positions == sorted(row.positions)

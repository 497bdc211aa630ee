"""Paragraphs, likeness and removals against plain computations; planted passages."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from cohortlib.llm import paragraphs as pg


def words(rnd, n):
    return ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(n)]


def prose(rnd, n):
    out, left = [], n
    while left > 0:
        k = min(left, rnd.randint(6, 18))
        out.append(" ".join(words(rnd, k)).capitalize() + rnd.choice([". ", ".\n", ", "]))
        left -= k
    return "".join(out)


def slow_units(text):
    """Word lists of the paragraphs."""
    units, fresh = [], True
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        gap = text[units[-1][-1].end():m.start()] if units else "\n"
        if fresh or "\n" in gap or "\r" in gap:
            units.append([])
        units[-1].append(m)
        fresh = m[0][-1] in ".,;:!?"
    return [[m[0] for m in u] for u in units], [u[0].start() for u in units]


def test_cuts_by_definition():
    rnd = random.Random(0)
    texts = ["", " \n ", "a", "One two. three\r\nfour,five, six", "x" * 9000, " lead. Trail. "] + [prose(rnd, 200) for _ in range(20)]
    found = pg.units([t.encode() for t in texts])
    for i, text in enumerate(texts):
        mine = np.flatnonzero(found.text == i)
        want, starts = slow_units(text)
        want, starts = zip(*((u, s) for u, s in zip(want, starts, strict=True)), strict=True) if want else ((), ())
        if all(len(u) <= pg.LONG for u in want):
            assert found.size[mine].tolist() == [len(u) for u in want] and found.start[mine].tolist() == list(starts)
        assert found.number[mine].tolist() == list(range(len(mine)))


def test_long_paragraphs_are_cut_alike_anywhere():
    rnd = random.Random(1)
    shared = words(rnd, 120)
    a, b = ([*words(rnd, k), *shared, *words(rnd, 9)] for k in (3, 40))
    found = pg.units([" ".join(a).encode(), " ".join(b).encode()])
    names = found.names()
    both = np.intersect1d(names[found.text == 0], names[found.text == 1])
    assert sum(found.size[(found.text == 0) & np.isin(names, both)]) > 60


@pytest.mark.parametrize("n", [5, 40])
@pytest.mark.parametrize("split", [False, True])
def test_exact_likeness(n, split):
    rnd = random.Random(n)
    sets = [np.unique(np.array(rnd.choices(range(12 if i % 2 else 30), k=rnd.randint(1, 14)), np.int64)) for i in range(n)]
    groups = np.array([i % 2 for i in range(n)]) if split else None
    old, pg.TILE = pg.TILE, 7
    try:
        got = set(zip(*(x.tolist() for x in pg.alike(sets, groups, 0.6)), strict=True))
    finally:
        pg.TILE = old
    want = {(i, j) for i, j in combinations(range(n), 2) if (groups is None or groups[i] != groups[j])
            and len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))}
    assert got == want


def test_bands_reach_the_recall():
    assert [pg.tune(0.8, 0.99, r) for r in (1, 2)] == [3, 5]
    rnd = np.random.default_rng(0)
    hit = 0
    for _ in range(400):
        base = rnd.integers(0, 2 ** 63, 18).astype(np.uint64)
        a, b = base[:17], np.concatenate((base[:16], base[17:]))         # likeness 16 / 18
        keys = pg.band_keys(np.concatenate((a, b)), np.array([0, len(a)]), 3, 1)
        hit += any(k[0] == k[1] for k in keys)
    assert hit >= 390


@pytest.mark.parametrize("hot", [1 << 12, 4])
def test_planted_passages(spark, docs, hot):
    rnd = random.Random(7)
    passages = [prose(rnd, k).replace(",", "") for k in (55, 70, 120)]
    rows = []
    for i in range(60):
        host = words(rnd, rnd.randint(30, 80))
        text = " ".join(host[:15]) + " " + (passages[i % 3] if i < 45 else "") + " ".join(host[15:])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " "), (103, prose(rnd, 400)), (None, rows[0][1]), (200, rows[2][1]), (200, rows[2][1])]
    edited = prose(rnd, 60).split(" ")
    rows += [(300 + k, " ".join(edited[:30] + [f"new{k}"] + edited[30:])) for k in range(6)]
    old, pg.HOT = pg.HOT, hot
    try:
        got = {}
        for r in pg.dedup(docs(rows, {"numbers": 1, "n_removed": "x", "doc": 3})).collect():
            got.setdefault(r.doc_id, []).append(r)
    finally:
        pg.HOT = old
    assert sum(map(len, got.values())) == len(rows)
    windows = {}
    for doc_id, found in got.items():
        for r in found[:1]:
            w = (r.text or "").lower().split()
            for k in range(len(w) - 49):
                windows.setdefault(tuple(w[k:k + 50]), set()).add(doc_id)
    assert not [v for v in windows.values() if len(v) > 1]
    for i in range(3):
        assert got[i][0].text == rows[i][1] and got[i][0].n_removed == 0          # the first of each stays whole
    for i in range(45, 60):
        assert got[i][0].text == rows[i][1]                                        # clean ones too
    assert all(15 < len(got[i][0].text.split()) < len(rows[i][1].split()) - 25 for i in range(3, 45))
    assert got[100][0].text is None and got[103][0].text == next(t for i, t in rows if i == 103)
    assert got[None][0].text == "" or len(got[None][0].text.split()) < 30


def test_unique_short_lines_stay(docs):
    rnd = random.Random(11)
    licence = " ".join(words(rnd, 25)) + "\n"
    glossary = "".join(" ".join(words(rnd, 4)) + "\n" for _ in range(500))
    one, two = (" ".join(words(rnd, 5)) + "\n" for _ in range(2))
    between = "".join(" ".join(words(rnd, 4)) + "\n" for _ in range(4))
    rows = [(1, licence), (2, glossary + licence), (3, one), (4, two), (5, one + between + two), (6, "at the\nend of\n" + licence + "last\nwords\n"),
            (7, "at the\nend of\n" + licence + "last\nwords\n")]
    got = {r.doc_id: r.text for r in pg.without_repeats(docs(rows)).collect()}
    assert got[2] == glossary and got[5] == rows[4][1]
    assert got[6] == rows[5][1].replace(licence, "")


def test_passage_in_the_middle_of_sentences(docs):
    rnd = random.Random(12)
    passage = " ".join(words(rnd, 20)) + ", " + " ".join(words(rnd, 20)) + ", " + " ".join(words(rnd, 12))
    hosts = [(" ".join(words(rnd, a)), " ".join(words(rnd, b)) + ".") for a, b in ((3, 9), (10, 4), (30, 40), (0, 2))]
    got = {r.doc_id: r.text for r in pg.dedup(docs([(i, f"{a} {passage} {b}") for i, (a, b) in enumerate(hosts)])).collect()}
    assert passage in got[0]
    assert all(got[i].split() == [*a.split(), *b.split()] for i, (a, b) in enumerate(hosts) if i)


@pytest.mark.parametrize(("n", "edits"), [(60, [30]), (50, [20]), (100, [30, 66]), (150, [40, 80, 117])])
def test_edits_inside_paragraphs(docs, n, edits):
    rnd = random.Random(n)
    base = words(rnd, n)
    for i in range(11, n, 12):
        base[i] += ","
    rows = []
    for k in range(4):
        copy = list(base)
        for at in edits if k else []:
            copy[at] = f"new{k}"
        rows.append((k, " ".join(words(rnd, 6)).capitalize() + ".\n" + " ".join(copy) + "\n" + " ".join(words(rnd, 7))))
    got = {r.doc_id: r.text for r in pg.dedup(docs(rows)).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 4):
        first, _, last = rows[k][1].split("\n")
        assert got[k].split() == f"{first} {last}".split()


def test_without_repeats_keeps_columns(docs):
    rnd = random.Random(3)
    text = prose(rnd, 90)
    df = docs([(2, text), (1, text), (3, None), (4, "")], {"n_removed": "mine", "text_hash": 1})
    got = pg.without_repeats(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_empty_table(empty):
    assert pg.dedup(empty).count() == 0 and pg.without_repeats(empty).columns == empty.columns


@pytest.mark.parametrize(("n", "around"), [(10, 300), (100, 500), (700, 4000)])
def test_own_words_between_long_repeated_passages_stay(docs, n, around):
    rnd = random.Random(n)
    one, two = prose(rnd, around), prose(rnd, around)
    own = prose(rnd, n)
    rows = [(1, one + two), (2, one + own + two), (3, one + two), (4, one + "\n" + own + "\n" + two)]
    got = {r.doc_id: r.text for r in pg.without_repeats(docs(rows)).collect()}
    assert got[1] == rows[0][1] and 3 not in got
    assert got[2].split() == own.split()
    assert set(got.get(4, "").split()) <= set(own.split())                     # it repeats what document 2 has of its own

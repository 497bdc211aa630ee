"""SimHash, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from cohortlib.llm import simhash
from cohortlib.llm.components import components, local_stars


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(prints, radius=2):
    """doc number -> numbers of its component, by comparing all pairs."""
    n = len(prints)
    pairs = [(i, j) for i in range(n) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]
    return roots(range(n), pairs)


def test_fingerprint_by_definition():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choices(["Foo", "bar", "É", "x", " ", "\n", " ", "\x0b", "baz "], k=rnd.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def family(rnd, n):
    """Numbers with many close to each other."""
    out = [rnd.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        x = rnd.choice(out)
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return sorted({*out, 0, 1, 3, 7, (1 << 64) - 1})


@pytest.mark.parametrize("hot", [1 << 15, 6])
@pytest.mark.parametrize("radius", [0, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, hot, radius):
    values = family(random.Random(radius), 400)
    values += [v ^ 1 << k for v in values[:2] for k in range(20, 40) if v ^ 1 << k not in values]      # a crowded part
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint bigint")
    got = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in simhash.links(table, radius, hot).collect()]
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= radius]
    assert roots(values, got) == roots(values, want)


def test_tiles_of_two_groups():
    rnd = random.Random(9)
    values = np.array(family(rnd, 300), np.uint64)
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    a, b = values[::2], values[1::2]
    got = simhash.near(a, b, 2, tile=16)
    want = [(int(x), int(y)) for x in a for y in b if bin(int(x) ^ int(y)).count("1") <= 2]
    nodes = [int(v) for v in values]
    assert roots(nodes, [(int(x), int(y)) for x, y in zip(*got, strict=True)]) == roots(nodes, want)


def test_table_and_components(spark, docs):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(60)]
    for t in texts[:20]:
        parts = t.split()
        parts[rnd.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    texts += [None, "", " \n", "one", "One", "one two", texts[0], texts[0]]
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts, strict=True)) + [(7000, "dup row x"), (7000, "dup row x")]
    prints = [slow_fingerprint(t) for _, t in rows]
    comp = groups(prints)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[comp[i]] = min(low.get(comp[i], doc_id), doc_id)
    want = sorted((rows[i][0], f"{prints[i]:016x}", low[comp[i]]) for i in range(len(rows)))
    got = simhash.near_duplicates(docs(rows, {"fingerprint": "x", "component_id": 3, "raw": 1}))
    assert sorted(map(tuple, got.collect())) == want
    kept = simhash.keep_one(docs(rows, {"fingerprint": "x", "row": 5}))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fingerprint", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))


def test_null_ids(docs):
    got = simhash.near_duplicates(docs([(None, "a b c d e"), (4, "a b c d e"), (None, "z y x")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4)]


def test_keep_one_of_null_and_repeated_ids(docs):
    rnd = random.Random(8)
    texts = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(999)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (9, texts[5]), (None, texts[5])]
    got = sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs(rows)).collect())
    assert got == sorted([(-1, texts[0]), (-1, texts[1]), (-1, texts[2]), (5, texts[3]), (5, texts[4]), (9, texts[5])])


def test_very_long_texts(docs):
    rnd = random.Random(12)
    long = " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(9999)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "short one here")]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{slow_fingerprint(t):016x}" for i, t in rows}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4]


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    pairs += [(rnd.randrange(400, 460), rnd.randrange(400, 460)) for _ in range(60)]
    pairs = [p if rnd.random() < 0.5 else p[::-1] for p in pairs] * 2
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}
    a, b = local_stars(*(np.array(x) for x in zip(*pairs, strict=True)))
    assert roots(want, zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(set(a.tolist()))

"""Ranked search against scoring every document, on small frames and on the test tables."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlib.llm import queries
from cohortlib.llm import ranked_search as rs

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(rs.TERM, (text or "").translate(LOWER))


def best(docs, items, k=10):
    """(item, rank, doc_id, score) by scoring every document."""
    found = [(i, Counter(plain(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in found:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **sizes):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    index = rs.build(d, sizes.pop("shard_bytes", rs.SHARD_BYTES), sizes.pop("block", rs.BLOCK))
    return sorted((tuple(r) for r in rs.search(index, i, k, **sizes).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 2000, "block": 4, "window": 8}, {"shard_bytes": 500, "block": 1, "window": 1, "query_terms": 10}])
def test_random_texts(spark, sizes):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i * 7 % 301, " ".join(r.choices(words, weights, k=r.choice([1, 3, 10, 40, 90])))) for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 6, 20])))) for i in range(20)]
    assert run(spark, docs, items, **sizes) == best(docs, items)


def test_nulls_ties_and_repeats(spark):
    docs = [(3, "Red Fox"), (1, "red fox"), (None, "red fox"), (2, "red fox"), (2, "red fox"), (4, None), (5, ""), (6, " .,! "), (7, "blue")]
    items = [(0, "fox"), (0, "blue"), (1, None), (2, ""), (3, "unknown"), (None, "fox fox"), (4, "fox RED")]
    for k in (2, 4, 10):
        got = run(spark, docs, items, k)
        assert got == best(docs, items, k)
    assert [r[2] for r in sorted(run(spark, docs, [(9, "fox")]), key=lambda r: r[1])] == [1, 2, 2, 3, None]


def test_term_rule(spark):
    docs = [(1, "naïve-café x1_y2 ÉCOLE"), (2, "école éCOLE"), (3, "x1 y2 na b")]
    items = [(0, "Naïve CAFÉ"), (1, "École"), (2, "X1,Y2"), (3, "école"), (4, "na b")]
    assert run(spark, docs, items) == best(docs, items)


def test_very_long_text(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices(["aa", "bb", "cc", "dd", "ee"], k=3))) for i in range(50)] + [(99, "aa " * 900_000 + "zz"), (98, "q" * 3_000_000)]
    items = [(0, "zz"), (1, "aa ee"), (2, "q" * 3_000_000)]
    assert run(spark, docs, items) == best(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(0, "a")]) == [] and run(spark, [(0, "a")], []) == [] and run(spark, [(0, None)], [(0, "a")]) == []


def test_extra_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5, "x", 1)], "doc_id bigint, text string, shard int, raw string, term int")
    i = spark.createDataFrame([(1, "a", 5, "x")], "item_id bigint, text string, q int, item string")
    assert [tuple(r)[:3] for r in rs.search(rs.build(d), i).collect()] == [(1, 1, 1)]


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**28 - 1, 2**28, 2**32 - 1])
    data, ends = rs.varints(values)
    assert rs.read_varints(data).tolist() == values.tolist() and ends[-1] == len(data)


def test_blocks_stay_compressed():
    """Blocks of lists that are not essential are read only where a candidate needs them."""
    texts = [b"common"] * 2000 + [b"common rare"]
    rows = rs.shard_rows(0, list(range(2001)), texts).to_pylist()
    m = 25 + 75 * np.array(rows[0]["lengths"]) * 2001 // 2002
    lists = {r["term"]: rs.Postings(r, m, lambda n: 25 + 75 * n * 2001 // 2002) for r in rows[1:]}
    found = rs.Best(1)
    rs.search_shard([(lists["rare"], 7000), (lists["common"], 1)], np.arange(2001), np.zeros(2001, bool), found, window=100)
    all_read = len(lists["common"].plain)
    found = rs.Best(1)
    found.add(np.array([6_000_000]), np.array([5]), np.array([False]))
    for x in lists.values():
        x.plain.clear()
    rs.search_shard([(lists["rare"], 7000), (lists["common"], 1)], np.arange(2001), np.zeros(2001, bool), found, window=100)
    assert len(lists["common"].plain) <= 1 < all_read


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()]
    got = queries.op13_ranked_search(spark, DATA).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == best(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))

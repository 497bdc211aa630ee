"""Every stage of the pipeline on its own input, against plain computations over that input."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from test_host_rules import measures, verdicts
from test_mixing import size, water
from test_simhash import groups, slow_fingerprint

import corpus_pipeline
from cohortlib.llm import paragraphs as pg
from cohortlib.llm.helpers import documents, stage

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    out = [documents(spark, DATA)]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], DATA), name))
    return [(t.columns, [r.asDict() for r in t.collect()]) for t in out]


def test_columns(tables):
    for columns, rows in tables[:5]:
        assert columns == tables[0][0] and rows
    assert "text" not in tables[5][0]


def test_quality_rules(tables):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in tables[0][1]]
    rates = verdicts(rows)
    assert sorted(r["doc_id"] for r in tables[1][1]) == sorted(i for i, t, s in rows if not measures(t)[-1] and rates[s] <= 0.5)


def test_near_duplicates(tables):
    """Three words and two bits, by all pairs; of each group the smallest id."""
    rows = tables[1][1]
    found = groups([slow_fingerprint(r["text"]) for r in rows])
    low = {}
    for i, r in enumerate(rows):
        low[found[i]] = min(low.get(found[i], r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in tables[2][1]) == sorted(low.values()) and len(low) < len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(texts[r["doc_id"]] == r["text"] for r in tables[2][1])


def windows(words, n):
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}


def kept_places(before, after):
    """True at each word of ``before`` that ``after`` still has, reading both from the front and from the back."""
    out, k = np.zeros(len(before), bool), 0
    for i, w in enumerate(before):
        if k < len(after) and w == after[k]:
            out[i], k = True, k + 1
    assert k == len(after)
    return out


def test_repeated_passages(tables):
    """By plain words. Nothing is added or put in another order; what a text loses are runs of LEAST_WORDS matched words or more that other
    texts keep, but for small edits inside of them; and no passage of 50 words is left in two texts."""
    before = {r["doc_id"]: r["text"].split() for r in tables[2][1]}
    after = {r["doc_id"]: r["text"].split() for r in tables[3][1]}
    assert set(after) <= set(before)
    lowered = {i: [w.lower() for w in t] for i, t in after.items()}
    left = defaultdict(int)
    for words in lowered.values():
        for x in windows(words, 5):
            left[x] += 1
    lost = strange = 0
    for i, words in before.items():
        gone = ~kept_places(words, after.get(i, []))
        low = [w.lower() for w in words]
        covered = np.zeros(len(words), bool)
        for k in range(len(words) - 4):
            if tuple(low[k:k + 5]) in left:
                covered[k:k + 5] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone & ~covered, [False])).astype(int)))
        lost += int(gone.sum())
        strange += sum(max(0, int(b - a) - pg.EDIT) for a, b in zip(edges[::2], edges[1::2], strict=True))
    assert lost and strange == 0
    shared = defaultdict(set)
    for i, words in lowered.items():
        for x in windows(words, 50):
            shared[x].add(i)
    assert not [x for x, held in shared.items() if len(held) > 1]


def test_mix(tables):
    before, after = tables[3][1], tables[4][1]
    sizes, taken, longest, copies = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in after:
        taken[r["source"]] += size(r["text"])
        copies[r["doc_id"]] += 1
    order = sorted(sizes, key=lambda s: s.encode())
    want = water(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_tokens(tables):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as p
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = sorted((r["doc_id"], encode(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in tables[4][1])
    assert sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in tables[5][1]) == want


def test_whole_run_and_empty_table(spark, tables, tmp_path):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r["ids_sha256"] for r in tables[5][1])
    documents(spark, DATA).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Byte-level BPE against tiktoken, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from cohortlib.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def tiktoken_encode(vocab):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={}).encode_ordinary


def texts(n, seed):
    rnd = random.Random(seed)
    letters = [chr(c) for c in (*range(0, 600), *range(0x2000, 0x2070), *range(0x3040, 0x30A0), *range(0x1F600, 0x1F640), 0x85, 0xA0)]
    letters += ["aaaa", "    ", "'s", "the ", "\n\n\n", "<|endoftext|>"] * 5 + [" "] * 60
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 90))) for _ in range(n)]


def test_same_ids_as_tiktoken(vocab, tiktoken_encode):
    some = [*texts(1500, 3), "", "a" * 5000, " " * 3000, "ab" * 3000, "aaab" * 500, "\n" * 77, "é" * 1001]
    for ids, text in zip(bpe.encode_block(vocab, regex.compile(public_tokenizers.PATTERN), some), some, strict=True):
        assert ids.tolist() == tiktoken_encode(text)
        assert bpe.decode(vocab, ids) == text.encode()


def test_words_whose_merges_bring_up_a_lower_pair():
    """A vocabulary in which the order of ranks and the order of merges differ."""
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"ab", b"xa"[::-1], b"abab", b"xabx"]
    vocab = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    rnd = random.Random(0)
    words = ["".join(rnd.choices("abx", k=rnd.randint(1, 12))).encode() for _ in range(800)]
    ids, starts = bpe.encode_words(vocab, words)
    for i, word in enumerate(words):
        want = [vocab.ranks[word]] if word in vocab.ranks else vocab.plain(word)
        assert ids[starts[i]:starts[i + 1]].tolist() == want


def test_table(spark, docs, tiktoken_encode):
    rows = [(1, None), (2, ""), (3, "Hello  world's é\n\n x"), (3, "Hello  world's é\n\n x"), (4, "long " * 20_000)]
    rows += [(10 + i, t.replace("\0", "")) for i, t in enumerate(texts(60, 5))]
    got = bpe.encoded(docs(rows, {"ids": "mine", "n_tokens": 1}), PATH, public_tokenizers.PATTERN, block_bytes=5000)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(rows) and len(by_id[3]) == 2
    for doc_id, text in rows:
        r, want = by_id[doc_id][0], tiktoken_encode(text or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(empty):
    assert bpe.digests(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_runs_of_one_pair():
    assert bpe._alternate(np.array([0, 1, 2, 3, 7, 8]), np.arange(1, 20)).tolist() == [0, 2, 7]

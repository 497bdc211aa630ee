"""The PPM trie and the word base against dictionaries; held-out texts."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlib.llm import ppm


class Slow:
    """The model of the docstring, byte by byte."""

    def __init__(self, texts, order):
        self.order, self.totals, self.kept = order, Counter(), defaultdict(dict)
        counts = [Counter() for _ in range(order + 2)]
        for text in texts:
            s = self.framed(text)
            for j in range(order, len(s)):
                for n in range(order + 1):
                    counts[n + 1][s[j - n:j + 1]] += 1
        for n in range(1, order + 2):
            for gram, c in counts[n].items():
                self.totals[gram[:-1]] += c
                self.kept[gram[:-1]][gram[-1]] = c

    def framed(self, text):
        return b"\n" * self.order + b" ".join((text or "").encode().lower().split()) + b"\n"

    def score(self, text):
        s = self.framed(text)
        return sum(self.byte(s[j - self.order:j], s[j]) for j in range(self.order, len(s)))

    def byte(self, context, symbol):
        log, gone = 0.0, set()
        for n in range(self.order, -1, -1):
            c = context[len(context) - n:]
            if c not in self.kept:
                continue
            seen, left = self.kept[c], self.totals[c] - sum(self.kept[c][x] for x in gone)
            if symbol in seen:
                return log + math.log10((seen[symbol] - 0.5) / left)
            out = self.totals[c] - sum(seen.values()) + 0.5 * (len(seen) - len(gone))
            if out > 0 and left > 0:
                log += math.log10(out / left)
            gone = set(seen)
        return log - math.log10(256 - len(gone))


def some(seed, n=120):
    rnd = random.Random(seed)
    stems = ["tion", "the", "er", "Én", "a", "re", "xy"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choices(stems, k=rnd.randint(1, 3))) for _ in range(rnd.choice((0, 1, 5, 60)))]
        rows.append((i, None if rnd.random() < 0.05 else " ".join(words)))
    return rows


@pytest.mark.parametrize("order,most,frequent,sent", [(6, 1 << 20, 1 << 20, 1 << 20), (6, 50, 20, 0), (3, 300, 20, 0), (1, 5, 1, 1 << 20)])
def test_scores_by_definition(docs, order, most, frequent, sent):
    rows = some(order)
    rows += [rows[3], (None, "unseen ŵords \x00\x7f"), (999, "long " * 4000)]
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    training = [t for i, t in rows if not held[i]]
    model = Slow(training, order)
    counts = Counter(w for t in training for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    got = ppm.score(docs(rows, {"score": 1, "row": 2, "word": "x"}), order=order, frequent=frequent, block_bytes=9000, most=most, piece_bytes=2000, most_sent=sent).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b"\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score == pytest.approx(model.score(texts[r.doc_id]))


def test_probabilities_add_up_to_one(spark):
    """Over the 256 bytes that may follow a context, whether the trie has it in full, in part or not at all."""
    rnd = random.Random(0)
    texts = [bytes(rnd.choices(b"ab c", k=30)) for _ in range(40)]
    order = 3
    grams, _ = ppm.pack([ppm.normal(t) for t in texts], order)
    counts = Counter(grams.tolist())
    contexts = [b"abc", b"\n\n\n", b"zzz", b" a ", b"zab"]
    asked = {(s << 24) | (c[2] << 16) | (c[1] << 8) | c[0] for s in range(256) for c in contexts}
    counted = spark.createDataFrame([(g, counts[g]) for g in asked | set(counts)], "gram bigint, n bigint")
    log = {r.gram: r.log for r in ppm.log_probabilities(counted, *ppm.trie(counted, order)).collect()}
    for c in contexts:
        low = (c[2] << 16) | (c[1] << 8) | c[0]
        assert sum(10.0 ** log[(s << 24) | low] for s in range(256)) == pytest.approx(1.0)


def test_grams_below_a_millionth_of_the_corpus_count(docs):
    """A training word seen once beside 2.4 million other bytes is still predicted from its own contexts."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(train[0], "zyxwvutsrq"), (held, "zyxwvutsrq")] + [(i, "abcd efgh " * 6000) for i in train[1:41]]
    got = {r.doc_id: r.score for r in ppm.score(docs(rows)).collect()}
    assert got[held] == got[train[0]] > -16                # about -24 for ten bytes that no context predicts


def test_unseen_kind_of_text_scores_worse(docs):
    held = [i for i in range(5000, 5200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = some(8, 400) + [(i, "qqq zzz kkk jjj " * 10) for i in held]
    per = {r.doc_id: r.score / r.n_tokens for r in ppm.score(docs(rows)).collect() if r.held_out and r.n_tokens > 5}
    assert max(v for k, v in per.items() if k >= 5000) < min(v for k, v in per.items() if k < 5000)


def test_nothing_to_train_on(docs, empty):
    assert ppm.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ppm.score(docs([(held, "Ab c")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(-5 * math.log10(256))


def test_texts_are_summed_in_bounded_memory(docs):
    """Four megabytes of texts come to one task at once; the arrays made of them are those of a part."""
    rnd = random.Random(4)
    texts = [b"", *(b" ".join(rnd.choices([b"ab", b"cde", b"fghij"], k=rnd.randint(1, 400))) for _ in range(5000)), b"x" * (2 << 20)]
    assert sum(map(len, texts)) > 4 << 20
    grams = np.unique(np.concatenate([np.unique(ppm.pack(texts[i:i + 500], 6)[0]) for i in range(0, len(texts), 500)]))
    logs = -np.random.default_rng(0).random(len(grams)).astype(np.float32)
    tracemalloc.start()
    try:
        got = ppm.summed(grams, logs, texts, 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 180e6                                    # the long text alone; of all at once about 280 MB
    assert got.tolist() == [ppm.summed(grams, logs, [t], 6)[0] for t in texts]


def test_grams_are_counted_after_the_exchange_only(docs):
    """A task's grams are distinct, so counting them once more before they are shuffled would double the memory and gain nothing."""
    rows = docs([(1, "a b"), (2, "a b")]).selectExpr("cast(text as binary) raw", "doc_id = 2 held_out")
    plan = ppm.gram_counts(rows)._jdf.queryExecution().sparkPlan().toString()
    above = plan[:plan.index("MapInArrow")].splitlines()
    assert "Exchange" in above[-2] or "Exchange" in above[-1], plan


def test_grams_of_many_short_texts_are_sorted_without_an_index():
    """The number of a text is sorted with its grams, at most 256 texts at once, so no second array tells where each gram came from."""
    rnd = random.Random(5)
    texts = [b" ".join(rnd.choices([b"ab", b"\xc3\x89n", b"fghij", b"\xff\xfe"], k=rnd.randint(0, 9))) for _ in range(700)]
    texts += [b"y" + bytes(rnd.choices(b"abcdefgh ", k=900_000))]
    grams = np.unique(ppm.pack(texts, 6)[0])
    logs = -np.random.default_rng(0).random(len(grams)).astype(np.float32)
    tracemalloc.start()
    try:
        got = ppm.summed(grams, logs, texts, 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    slow = [sum(float(logs[np.searchsorted(grams, int.from_bytes((b"\n" * 6 + t + b"\n")[i:i + 7], "little"))]) for i in range(len(t) + 1)) for t in texts[:700]]
    assert got[:700].tolist() == pytest.approx(slow)
    assert got.tolist() == [ppm.summed(grams, logs, [t], 6)[0] for t in texts]
    assert peak < 46e6                                     # before: an index of the sort and a logarithm for each byte, 55 MB and more


def test_a_gram_is_counted_in_training_texts_only(docs):
    """Grams of held-out texts are listed with the counts of the training texts, 0 if these lack them, also over several pieces."""
    texts = [("ab ab", False), ("ab", True), ("zz", True), ("", False), ("ab", False)] * 50
    rows = docs([(i, t) for i, (t, _) in enumerate(texts)]).selectExpr("cast(text as binary) raw", "doc_id % 5 in (1, 2) held_out").coalesce(1)
    want = Counter()
    for t, held in texts:
        for g in ppm.pack([t.encode()], 6)[0].tolist():
            want[g] += not held
    for most, piece in ((1 << 20, 1 << 20), (3, 20)):
        assert {r.gram: r.n for r in ppm.gram_counts(rows, 6, most, piece).collect()} == dict(want)


def test_counting_takes_little_more_than_its_grams(docs):
    """Pieces are merged by putting in what is new, and packed without an index of bytes."""
    rnd = random.Random(4)
    grams, more = (np.unique(np.array([rnd.randrange(1 << 40) for _ in range(n)], np.int64)) for n in (200_000, 50_000))
    more = np.unique(np.concatenate((more, grams[::20])))
    counts, n = np.arange(len(grams)), np.arange(len(more)) + 3
    want = Counter(dict(zip(grams.tolist(), counts.tolist(), strict=True)))
    want.update(dict(zip(more.tolist(), n.tolist(), strict=True)))
    tracemalloc.start()
    got = ppm.merged(grams, counts, more, n)
    merging = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    del got
    text = bytes(rnd.choices(b"abcdefgh ", k=1 << 20))
    base = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    ppm.pack([text], 6)
    packing = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert merging < 30 * (len(grams) + len(more)) and packing < 16 * len(text)
    counts, n = np.arange(len(grams)), np.arange(len(more)) + 3
    got = ppm.merged(grams, counts, more, n)
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == dict(want)
    assert (np.diff(got[0]) > 0).all()

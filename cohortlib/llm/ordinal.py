"""Quality classifier: ordinal regression on graded ratings (a cumulative-link model).

All grades share one weight vector over hashed text features; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - weights . features). From this follow the expected grade and the
probability of at least a given grade, by which documents are selected.

Features say which words a text has (hashed, lower-cased, without the marks around them; also their first letters), which marks its words carry,
whether most are in upper case, and in bands how much it repeats itself and how many words are marked. Each counts once,
whatever the length of the text.

Features that are rare, or that have no tie to the grades by their chi-square, keep weight zero, so long texts do not add up
chance. The model is fitted in one task on a bounded sample of the labelled rows (``SAMPLE``, by a hash of the id); its size is
``BUCKETS`` weights, so it may be broadcast. Every document is scored, over its whole text. Null and empty texts have
one feature of their own. Ratings without a document, or with a null, are left out. Without any rating the
thresholds are those of equal grades, and everything is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import chunks, raw_text, stage

BUCKETS = 1 << 18
SAMPLE = 12_000
GRADES = 3
STEPS = 300
RATE = 0.05
PENALTY = 2e-4
PREFIX = 5
SHAPES = 64                                                # buckets beside the words', for marks and cases
LEAST = 5                                                  # sampled texts that a feature must be in, or an eighth of all
TIED = 30.0                                                # least chi-square between a feature and the grades, or a quarter of the texts
LIMIT = 0.5
BLOCK_BYTES = 4 << 20
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Hasher(dict):
    """Feature numbers of a word: its stripped form, and its shape if it is not plain."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(_MARKS)
        low = bare.lower()
        out = [zlib.crc32(low) % BUCKETS, zlib.crc32(low[:PREFIX] + b"-") % BUCKETS] if bare else []
        mark = word[len(bare):] if word.startswith(bare) else word.replace(bare, b"", 1)
        if len(mark) > 1 or not bare and mark:
            out.append(BUCKETS + zlib.crc32(mark) % SHAPES)
        if len(bare) > 1 and bare.isupper():
            out.append(_UPPER)
        found = self[word] = tuple(out) or (BUCKETS,)
        return found


BANDS = 8
_UPPER = BUCKETS + SHAPES
_REPEATS = _UPPER + 1
_MARKED = _REPEATS + BANDS
_EMPTY = _MARKED + BANDS
WIDTH = _EMPTY + 1


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and where each text's start (one more entry than texts)."""
    hasher = Hasher()
    out, ends = [], [0]
    for raw in raws:
        words = raw.split()
        if not words:
            found = {_EMPTY}
        else:
            kinds = set(words)
            found = {n for w in kinds for n in hasher[w]}
            marked = sum(hasher[w][-1] >= BUCKETS for w in kinds)
            upper = sum(hasher[w][-1] == _UPPER for w in kinds)
            if 2 * upper < len(kinds):
                found.discard(_UPPER)                      # one for texts that are mostly upper case
            pairs = len(set(zip(words, words[1:], strict=False)))
            found.add(_REPEATS + min(int(BANDS * (1 - pairs / max(len(words) - 1, 1))), BANDS - 1))
            found.add(_MARKED + min(int(BANDS * marked / len(kinds)), BANDS - 1))
        out.append(np.fromiter(found, np.int64, len(found)))
        ends.append(ends[-1] + len(out[-1]))
    return np.concatenate(out) if out else np.empty(0, np.int64), np.array(ends)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool

    def at_least(self, raws: list[bytes]) -> np.ndarray:
        """P(grade >= k) of each text for k = 1 .. grades - 1."""
        columns, ends = features(raws)
        score = np.add.reduceat(self.weights[columns], ends[:-1]) if len(raws) else np.empty(0)
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(raws: list[bytes], grades: np.ndarray, levels: int = GRADES, steps: int = STEPS, rate: float = RATE,
        penalty: float = PENALTY) -> Model:
    """Maximum likelihood with a ridge penalty, by full-batch Adam from zero weights; the result does not depend on row order
    beyond rounding. Thresholds are kept in order by fitting the logarithms of their gaps."""
    shares = (np.bincount(grades, minlength=levels) + 1) / (len(grades) + levels)
    cuts = np.cumsum(shares)[:-1]
    start = np.log(cuts / (1 - cuts))
    if not len(grades):
        return Model(np.zeros(WIDTH), start, False)
    columns, ends = features(raws)
    rows = np.repeat(np.arange(len(raws)), np.diff(ends))
    seen = np.stack([np.bincount(columns[grades[rows] == g], minlength=WIDTH) for g in range(levels)]).astype(float)
    total = seen.sum(axis=0)
    usual = total[None, :] * (np.bincount(grades, minlength=levels) / len(grades))[:, None]
    tied = ((seen - usual) ** 2 / np.maximum(usual, 1e-9)).sum(axis=0)
    often = (total >= min(LEAST, len(grades) / 8)) & (tied >= min(TIED, len(grades) / 4))
    known = often[columns]                                 # all others keep weight zero
    place = np.cumsum(often) - 1
    columns, rows, width = place[columns[known]], rows[known], int(often.sum())
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    value = np.concatenate((np.zeros(width), free))
    first, second = np.zeros_like(value), np.zeros_like(value)
    n = len(grades)
    for step in range(1, steps + 1):
        weights, free = value[:width], value[width:]
        theta = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
        score = np.bincount(rows, weights[columns], n)
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        high, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        mass = np.maximum(high - low, 1e-12)
        slope_high[grades == levels - 1] = 0
        slope_low[grades == 0] = 0
        by_score = (slope_high - slope_low) / mass / n      # derivative of the loss by each score
        by_theta = np.zeros(levels - 1)
        np.add.at(by_theta, np.minimum(grades, levels - 2), -np.where(grades < levels - 1, slope_high / mass, 0) / n)
        np.add.at(by_theta, np.maximum(grades - 1, 0), np.where(grades > 0, slope_low / mass, 0) / n)
        gradient = np.concatenate((np.bincount(columns, by_score[rows], width) + penalty * weights,
                                   [by_theta.sum()], [by_theta[k:].sum() * np.exp(free[k]) for k in range(1, levels - 1)]))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        value = value - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights = np.zeros(WIDTH)
    weights[often], free = value[:width], value[width:]
    return Model(weights, np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:])))), True)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each rated document: 0 toxic, 1 poor, 2 good; of several ratings the lowest counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return (labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
            .groupBy("doc_id").agg(F.min("grade").alias("grade")))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, levels: int = GRADES) -> Model:
    """Fit on at most ``sample`` rated documents, those whose id has the smallest hash; equal texts count once."""
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)                  # bounded, hence broadcast
    texts = (docs.select("doc_id", raw_text().alias("raw")).join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(F.max("raw").alias("raw"), F.min("grade").alias("grade")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text = {}
        for batch in batches:
            for raw, grade in zip(batch.column("raw").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                by_text[raw] = min(grade, by_text.get(raw, grade))
        raws = sorted(by_text)
        model = fit(raws, np.array([by_text[r] for r in raws], np.int64), levels)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tobytes()]), pa.array([model.fitted])],
                                         ["weights", "thresholds", "fitted"])

    schema = "weights binary, thresholds binary, fitted boolean"
    row = stage(texts, "rated_texts").repartition(1).mapInArrow(run, schema).first()
    if row is None:
        return fit([], np.empty(0, np.int64), levels)
    return Model(np.frombuffer(row["weights"]), np.frombuffer(row["thresholds"]), row["fitted"])


def judge(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, expected_grade, p_at_least_poor, p_good (the tail probabilities of grades 1 and 2) and kept of every document.

    A document is kept if its probability of the highest grade is ``limit`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", BLOCK_BYTES):
            tail = sent.value.at_least(block.column("raw").to_pylist())
            kept = tail[:, -1] >= limit if sent.value.fitted else np.ones(len(tail), bool)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(tail.sum(axis=1)), pa.array(tail[:, 0]), pa.array(tail[:, -1]),
                                              pa.array(kept)], ["doc_id", "expected_grade", "p_at_least_poor", "p_good", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", raw_text().alias("raw")).mapInArrow(
        run, f"doc_id {kind}, expected_grade double, p_at_least_poor double, p_good double, kept boolean")


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, graded(labels)))

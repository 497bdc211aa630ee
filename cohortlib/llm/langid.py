"""Language identification by n-gram filters that answer for all languages at once.

All byte n-grams of all labelled texts go into one bit-sliced Bloom filter: each slot holds two bits for each language, and
the bitwise and of an n-gram's slots names all languages that have it, and those in which it is frequent (at least 1/FREQUENT of
the language's n-grams). Frequent ones keep languages apart in a corpus so large that stray words bring nearly every n-gram
into each of them. The filter has ROOM slots for each n-gram of the richest language, up to MOST_SLOTS, which
bounds what is broadcast; a fuller filter gives more false positives, which are corrected, and never loses an n-gram. A text's n-grams
are looked up, each language's bits are counted, the counts are corrected for the share of false positives that the
filter gives for that bit, and the language with the highest mean of its two corrected shares wins.

Letters A-Z are lower-cased, other ASCII characters separate words, and everything else is kept as bytes. A null text, or
one without a letter, is ``und`` with score 0. Null labels teach nothing. Among equal shares the language with the
smaller name wins; a text without any known n-gram gets the language with the most training texts, with score 0.
Without any labelled text everything is ``und``. Repeated rows count each time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import chunks, fold, mix64, raw_text, stage

NGRAM = 4
FREQUENT = 1 << 14
ROOM = 8
MOST_SLOTS = 1 << 22                                       # of 8 bytes for each 32 languages
HASHES = 3
BLOCK_BYTES = 2 << 20
UNKNOWN = "und"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def clean(raw: bytes) -> bytes:
    """Words joined and framed by spaces, long enough for one n-gram; empty if there is no word."""
    words = raw.translate(_TABLE).split()
    return b" " + b" ".join(words) + b"  " if words else b""


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts in a row, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts) + b"\0" * NGRAM, np.uint8)
    packed = np.zeros(len(flat) - NGRAM, np.uint32)
    for i in range(NGRAM):
        packed |= flat[i:i + len(packed)].astype(np.uint32) << np.uint32(8 * (NGRAM - 1 - i))
    counts = np.maximum(lengths - (NGRAM - 1), 0)
    keep = np.ones(len(packed), bool)
    ends = np.cumsum(lengths)
    for i in range(1, NGRAM):                              # n-grams that would reach into the next text
        keep[ends[lengths >= i] - i] = False
    return packed[keep], counts


def slots(found: np.ndarray, size: int, hashes: int = HASHES) -> list[np.ndarray]:
    """The filter slots of each n-gram: two halves of one hash, combined."""
    h = mix64(found)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) % np.uint64(size)).astype(np.int64) for i in range(hashes)]


@dataclass
class Filter:
    """masks[slot, w] holds the bits of languages 32 w .. 32 w + 31, for each whether it has the n-gram and whether it is
    frequent there; false_positive has one rate for each bit."""

    languages: list[str]
    texts: np.ndarray
    masks: np.ndarray

    def __post_init__(self):
        filled = np.array([((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(2 * len(self.languages))])
        self.false_positive = filled ** HASHES

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of cleaned texts, each with an n-gram at least."""
        found, counts = grams(texts)
        at = slots(found, len(self.masks))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        share = np.empty((len(texts), 2 * len(self.languages)))
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            hits = column[at[0]]
            for s in at[1:]:
                hits &= column[s]
            for i in range(64 * word, min(64 * word + 64, share.shape[1])):
                bits = ((hits >> np.uint64(i % 64)) & np.uint64(1)).astype(np.uint8)
                share[:, i] = np.add.reduceat(bits, starts, dtype=np.int64) / counts
        share = np.maximum(share - self.false_positive, 0) / np.maximum(1 - self.false_positive, 1e-9)
        share = (share[:, 0::2] + share[:, 1::2]) / 2
        best = share.argmax(axis=1)
        score = share[np.arange(len(texts)), best]
        best[score == 0] = int(self.texts.argmax())
        return [self.languages[i] for i in best], score


def language_grams(labelled: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, gram, n over all texts (columns raw, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", block_bytes):
            by = defaultdict(list)
            for raw, lang in zip(block.column("raw").to_pylist(), block.column("lang").to_pylist(), strict=True):
                if len(text := clean(raw)):
                    by[lang].append(text)
            for lang, texts in by.items():
                found, n = np.unique(grams(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)],
                                                 ["lang", "gram", "n"])

    return (labelled.select("raw", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def learn(labelled: DataFrame, most_slots: int = MOST_SLOTS) -> Filter:
    """A filter from all labelled texts. The driver sees one row for each language, and the slots in use."""
    spark = labelled.sparkSession
    known = stage(language_grams(labelled), "language_grams")
    texts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = {r["lang"]: r for r in known.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
    richest = max((r["kinds"] for r in sums.values()), default=0)
    size = min(most_slots, 1 << max(richest * ROOM - 1, 1).bit_length())
    languages = sorted(texts)
    if not languages:
        return Filter([], np.zeros(0), np.zeros((1, 1), np.uint64))
    table = spark.createDataFrame([(x, i // 32, 2 * (i % 32), sums[x]["total"] if x in sums else 0) for i, x in enumerate(languages)],
                                  "lang string, word int, bit int, total bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(slots(batch.column("gram").to_numpy().astype(np.uint32), size))
            word = np.tile(batch.column("word").to_numpy(), HASHES)
            mask = np.tile(batch.column("bits").to_numpy().astype(np.uint64) << batch.column("bit").to_numpy().astype(np.uint64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word), pa.array(mask.view(np.int64))], ["slot", "word", "mask"])

    used = (known.join(F.broadcast(table), "lang")
            .select("gram", "word", "bit", F.when(F.col("n") * F.lit(FREQUENT) >= F.col("total"), 3).otherwise(1).alias("bits"))
            .mapInArrow(run, "slot bigint, word int, mask bigint")
            .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow())
    masks = np.zeros((size, (len(languages) + 31) // 32), np.uint64)
    masks[used.column("slot").to_numpy(), used.column("word").to_numpy()] = used.column("mask").to_numpy().view(np.uint64)
    return Filter(languages, np.array([texts[x] for x in languages]), masks)


def predict(docs: DataFrame, found: Filter, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out (as given), lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in chunks(batches, "raw", block_bytes):
            texts = [clean(raw) if has_letter(raw) else b"" for raw in block.column("raw").to_pylist()]
            told = np.flatnonzero([bool(t) for t in texts]) if model.languages else np.empty(0, np.int64)
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if len(told):
                guessed, score[told] = model.predict([texts[i] for i in told])
                for i, name in zip(told.tolist(), guessed, strict=True):
                    names[i] = name
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "raw").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """Learn from the labelled documents whose crc32 of the id modulo ``mod`` is not ``held``; predict all of them."""
    rows = docs.select("doc_id", "lang", raw_text().alias("raw"), (fold("doc_id", mod) == held).alias("held_out"))
    return predict(rows, learn(rows.where("not held_out and lang is not null")))

"""Scoring texts with prediction by partial matching (PPM), pretrained on a part of the corpus.

A text is its lower-cased words joined by single spaces, then an end byte. A trie over the last ``ORDER`` bytes holds
how often each byte followed each context. A byte is predicted in the longest context the trie has; a byte not seen
there costs an escape (method D: each distinct byte of a context gives half a count to its escape) to the context one
byte shorter, in which the bytes already ruled out are excluded. Below the empty context all bytes left are equally likely.

The trie is a set of tables, one for the grams and one for the contexts of each length, and holds every gram of the
training texts, so it grows with the corpus. Tasks count the distinct grams of ORDER + 1 bytes that they meet, Spark adds
the counts up and finds the log probability of each distinct gram by joins along the escapes; a text's score is the sum over
its grams. Up to ``SENT`` distinct grams their logarithms are broadcast. Beyond that texts are dealt into blocks of
``BLOCK_BYTES`` of text or ``MOST_HELD`` distinct grams, and each block gets the logarithms of its own grams by a
join. Both ways give the same scores.

Beside it stands the base score: an add-one word unigram model with exact counts of all training words. Words with at
least 1/FREQUENT of all tokens (so at most FREQUENT words) are looked up in a broadcast table; all others meet their counts in a join.

Null, empty and blank texts consist of the end token alone. With no training text the trie is empty, all bytes are
equally likely, and every token is unknown. Repeated rows are scored each, and count each time in training.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlib.llm.helpers import chunks, fold, partitions, raw_text, stage

ORDER = 6                                                  # at most 6: a gram of ORDER + 1 bytes must stay below 2**63
FREQUENT = 1 << 20
BLOCK_BYTES = 32 << 20
MOST_HELD = 1 << 22
SENT = 1 << 23                                             # of 12 bytes each
PIECE_BYTES = 2 << 20                                      # sorted at once
SUM_BYTES = 1 << 20                                        # of text whose grams are looked up at once, about 50 bytes each
SUM_TEXTS = 1 << 8                                         # their number within these must fit one byte
COUNT_BYTES = 8 << 20
HALF = 0.5                                                 # of a count goes to the escape, for each distinct byte
END = 10                                                   # no word contains a line feed


def normal(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def pack(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each text and at its end, newest byte highest, and where each text starts.

    Before a text stand end bytes, so that grams at its start are as long as all others."""
    pad = bytes([END]) * order
    flat = b"".join(x for t in texts for x in (pad, t, pad[:1] or b"\n")) + bytes(8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    oldest = np.ones(len(flat) - 8, bool)                  # all bytes but the last ``order`` of a text begin a gram
    for i in range(1, order + 1):
        oldest[np.cumsum(lengths + order) - i] = False
    # Eight bytes from a gram's oldest one on, lowest first, are one number; those after the gram are masked.
    grams = np.ndarray(len(flat) - 8, "<i8", flat, strides=(1,))[oldest]
    grams &= (1 << (8 * (order + 1))) - 1
    return grams, starts


def merged(grams: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct grams with their counts as one. Only new grams are put in, so nothing is sorted again; the
    counts of the first list are added to in place."""
    if not len(grams):
        return more, n
    at = np.searchsorted(grams, more)
    known = grams[np.minimum(at, len(grams) - 1)] == more
    counts[at[known]] += n[known]
    at, more, n = at[~known], more[~known], n[~known]
    return np.insert(grams, at, more), np.insert(counts, at, n)


def gram_counts(rows: DataFrame, order: int = ORDER, most: int = MOST_HELD, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """gram, n for all distinct grams of order + 1 bytes; ``n`` counts it in the training texts and may be 0.

    ``rows`` has raw, held_out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for piece in chunks(batches, "raw", piece_bytes):
            texts = [normal(t) for t in piece.column("raw").to_pylist()]
            held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(np.int8)
            if texts:
                found, starts = pack(texts, order)
                found <<= 1                                # sorted with the bit of its text, so one sort serves both kinds
                found |= np.repeat(held, np.diff(starts, append=len(found)))
                found.sort()
                learned = found.astype(np.int8)
                learned &= 1
                learned ^= 1
                found >>= 1
                first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                more, n = found[first], np.add.reduceat(learned, first, dtype=np.int64)
                del found, learned, first
                grams, counts = merged(grams, counts, more, n)
            if len(grams) >= most:                         # bounded memory, whatever the task reads
                yield from listed(grams, counts)
                grams, counts = grams[:0], counts[:0]
        yield from listed(grams, counts)

    def listed(grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(grams), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i:i + (1 << 16)]), pa.array(counts[i:i + (1 << 16)])], ["gram", "n"])

    # A task's grams are distinct already, so they are added up after the exchange only.
    return (rows.select("raw", "held_out").mapInArrow(run, "gram bigint, n bigint").repartition("gram")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def dealt(rows: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, most: int = MOST_HELD,
          piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """block, row, doc_id, held_out, raw for each text (normalised), and block, gram for each distinct gram of a block."""
    names = ["block", "row", "doc_id", "held_out", "raw", "gram"]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = TaskContext.get().partitionId() << 33          # numbers that are fixed once the table is written
        grams, size, types = np.empty(0, np.int64), 0, None

        def close() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(grams), 1 << 16):
                part = grams[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), *(pa.nulls(len(part), t) for t in types),
                                                  pa.array(part)], names)

        for piece in chunks(batches, "raw", piece_bytes):
            texts = [normal(t) for t in piece.column("raw").to_pylist()]
            told = [pa.array(np.arange(row, row + len(texts))), piece.column("doc_id"), piece.column("held_out"), pa.array(texts, pa.binary())]
            types = [c.type for c in told]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), block)), *told, pa.nulls(len(texts), pa.int64())], names)
            row += len(texts)
            grams = np.union1d(grams, pack(texts, order)[0])
            size += sum(map(len, texts))
            if size >= block_bytes or len(grams) >= most:
                yield from close()
                grams, size, block = grams[:0], 0, block + 1
        yield from close()

    return stage(rows.select("doc_id", "raw", "held_out").mapInArrow(
        run, f"block bigint, row bigint, doc_id {kind}, held_out boolean, raw binary, gram bigint"), "dealt")


def trie(counted: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of the grams of 1, 2, .. order + 1 bytes (gram, n) and of the contexts of 0, 1, .. order bytes.

    A context has its ``total`` and how many bytes are ``distinct`` in it; ``left`` and ``out`` are what the next shorter
    context holds, and gives to its escape, without the bytes that this context has. Every gram's suffixes are
    counted too, so a context's shorter ones are always there."""
    levels = [counted.where("n > 0").select("gram", "n")]
    for size in range(order, 0, -1):
        levels.append(stage(levels[-1].groupBy(F.shiftright("gram", 8).alias("gram")).agg(F.sum("n").alias("n")), f"grams_{size}"))
    levels.reverse()
    contexts = []
    for size, level in enumerate(levels):
        here = level.withColumn("context", F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1)))
        sums = [F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct")]
        if size == 0:
            table = here.groupBy("context").agg(*sums).select("*", F.lit(0).cast("long").alias("left"), F.lit(0.0).alias("out"))
        else:
            lower = levels[size - 1].select(F.col("gram").alias("lower"), F.col("n").alias("low"))
            table = (here.withColumn("lower", F.shiftright("gram", 8)).join(lower, "lower")
                     .groupBy("context").agg(*sums, F.sum("low").alias("excluded"))
                     .withColumn("up", F.shiftright("context", 8))
                     .join(contexts[-1].select(F.col("context").alias("up"), F.col("total").alias("t"), F.col("distinct").alias("d")), "up")
                     .select("context", "total", "distinct", (F.col("t") - F.col("excluded")).alias("left"),
                             (HALF * (F.col("d") - F.col("distinct"))).alias("out")))
        contexts.append(stage(table, f"contexts_{size}"))
    return levels, contexts


def log_probabilities(counted: DataFrame, levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """gram, log: log10 probability of the newest byte of each counted gram in the context of the others."""
    order = len(contexts) - 1
    mask = F.lit((1 << (8 * order)) - 1)
    seen = (counted.where("n > 0").withColumn("context", F.col("gram").bitwiseAND(mask))
            .join(contexts[order].select("context", "total"), "context")
            .select("gram", F.log10((F.col("n") - HALF) / F.col("total")).alias("log")))
    kinds = levels[0].count()                              # at most 256
    rest = counted.where("n = 0").select("gram", F.lit(0.0).alias("log"), F.lit(False).alias("done"),
                                         F.lit(None).cast("long").alias("left"), F.lit(None).cast("double").alias("out"))
    for size in range(order, -1, -1):
        # Tables of short contexts have at most 256, 65,536 rows, and their few keys would gather the rows.
        small = (lambda t: F.broadcast(t)) if size < 2 else (lambda t: t)
        back = 8 * (order - size)
        table = contexts[size].select(F.col("context").alias("c"), F.col("total").alias("t"), F.col("distinct").alias("d"),
                                      F.col("left").alias("next_left"), F.col("out").alias("next_out"))
        rest = rest.join(small(table), F.shiftright(F.col("gram").bitwiseAND(mask), back) == F.col("c"), "left")
        if size < order:
            rest = rest.join(small(levels[size].select(F.col("gram").alias("g"), "n")), F.shiftright("gram", back) == F.col("g"), "left")
        else:
            rest = rest.withColumn("n", F.lit(None).cast("long"))
        left, out = F.coalesce("left", "t"), F.coalesce("out", HALF * F.col("d"))
        there = ~F.col("done") & F.col("t").isNotNull()
        escape = F.when((left > 0) & (out > 0), F.log10(out / left)).otherwise(0.0)
        rest = rest.select(
            "gram",
            F.when(there, F.col("log") + F.when(F.col("n").isNotNull(), F.log10((F.col("n") - HALF) / left)).otherwise(escape))
            .otherwise(F.col("log")).alias("log"),
            (F.col("done") | F.col("n").isNotNull()).alias("done"),
            F.when(there, F.col("next_left")).otherwise(F.col("left")).alias("left"),
            F.when(there, F.col("next_out")).otherwise(F.col("out")).alias("out"))
    none = float(np.log10(max(256 - kinds, 1)))
    return seen.unionByName(rest.select("gram", (F.col("log") - F.when(F.col("done"), 0.0).otherwise(none)).alias("log")))


def summed(grams: np.ndarray, logs: np.ndarray, texts: list[bytes], order: int, sum_bytes: int = SUM_BYTES) -> np.ndarray:
    """log10 probability of each text; ``grams`` (sorted) has all of its grams. Texts are taken by ``sum_bytes`` (one long text may
    exceed it) and at most ``SUM_TEXTS``, so that memory is bounded and what is sorted stays near the core."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    out, start = [], 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SUM_TEXTS, int(np.searchsorted(ends, base + sum_bytes, "right"))))
        out.append(_summed(grams, logs, texts[start:stop], order))
        start = stop
    return np.concatenate(out)


def _summed(grams: np.ndarray, logs: np.ndarray, texts: list[bytes], order: int) -> np.ndarray:
    """Each distinct gram is looked up once. A gram has seven bytes at most, so the text's number is sorted with it as the eighth."""
    packed, starts = pack(texts, order)
    found = packed.view(np.uint64)
    found <<= np.uint64(8)
    found |= np.repeat(np.arange(len(texts), dtype=np.uint8), np.diff(starts, append=len(found)))
    found.sort()
    text = found.astype(np.uint8)                          # its lowest byte
    found >>= np.uint64(8)
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    each = np.repeat(logs[np.searchsorted(grams, packed[first])], np.diff(first, append=len(found)))
    return np.bincount(text, each, len(texts))


def by_gram(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The columns gram and log in the order of the grams."""
    grams, logs = table.column("gram").to_numpy(), table.column("log").to_numpy()
    del table
    by = np.argsort(grams)
    return grams[by], logs[by]


def word_counts(texts: DataFrame, block_bytes: int = COUNT_BYTES) -> DataFrame:
    """word, n of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", block_bytes):
            seen: Counter[bytes] = Counter()
            for text in block.column("raw").to_pylist():
                seen.update(text.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, mod: int = 7, held: int = 2, order: int = ORDER, frequent: int = FREQUENT,
          block_bytes: int = BLOCK_BYTES, most: int = MOST_HELD, piece_bytes: int = PIECE_BYTES, most_sent: int = SENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Documents are held out if crc32 of the id modulo ``mod`` is ``held``; all others train both models."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", raw_text().alias("raw"), (fold("doc_id", mod) == held).alias("held_out"))
    counted = stage(gram_counts(rows, order, most, piece_bytes), f"grams_{order + 1}")
    logs = log_probabilities(counted, *trie(counted, order)).select("gram", F.col("log").cast("float").alias("log"))
    training = rows.where("not held_out").select("raw")
    words = stage(word_counts(training), "words")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    tokens, kinds = n_words + ends, distinct + (1 if ends else 0)
    least = tokens / frequent                              # at most ``frequent`` words have so many
    got = words.where(F.col("n") >= least).toArrow()
    common = dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True))
    log_all = float(np.log10(tokens + kinds + 1))
    whole = None
    at_most = counted.count() <= most_sent
    if at_most:
        whole = by_gram(logs.toArrow())
    sent = spark.sparkContext.broadcast((whole, {w: float(np.log10(n + 1)) for w, n in common.items()}))
    del whole, got, common
    log_end = float(np.log10(ends + 1))

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grams, logs), known = sent.value
        row = TaskContext.get().partitionId() << 33        # a number for each row, fixed once the table is written
        for block in chunks(batches, "raw", piece_bytes):
            n = block.num_rows
            yield from scored_block(pa.array(np.arange(row, row + n)), block, [t.lower().split() for t in block.column("raw").to_pylist()], grams, logs, known)
            row += n

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[1]
        parts, grams, logs, now = [], np.empty(0, np.int64), np.empty(0, np.float32), None
        for batch in batches:
            key = batch.column("key").to_numpy()
            cuts = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] & 1 == 0:                        # the block's grams come before its texts
                    if key[a] != now:
                        parts, grams, now = [], np.empty(0, np.int64), key[a]
                    parts.append([batch.column(c).slice(a, b - a).to_numpy() for c in ("gram", "log")])
                    continue
                if parts:
                    grams, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
                    by = np.argsort(grams)
                    parts, grams, logs = [], grams[by], logs[by]
                for block in chunks([batch.slice(a, b - a)], "raw", piece_bytes):
                    yield from scored_block(block.column("row"), block, [t.split() for t in block.column("raw").to_pylist()], grams, logs, known)

    def scored_block(rows: pa.Array, block: pa.RecordBatch, split: list[list[bytes]], grams: np.ndarray, logs: np.ndarray,
                     known: dict) -> Iterator[pa.RecordBatch]:
        n, size = len(split), np.fromiter(map(len, split), np.int64, len(split))
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        word = np.fromiter(map(seen.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        text = np.repeat(np.arange(n), size)
        log = np.fromiter(map(known.get, seen, repeat(np.nan)), float, len(seen))[word]
        common = ~np.isnan(log)
        cols = {"row": rows, "doc_id": block.column("doc_id"), "held_out": block.column("held_out"),
                "n_tokens": pa.array(size + 1), "n_common": pa.array(np.bincount(text[common], minlength=n)),
                "log_common": pa.array(np.bincount(text[common], log[common], n).astype(float)),
                "score": pa.array(summed(grams, logs, [b" ".join(words) for words in split], order)), "word": pa.nulls(n, pa.binary()),
                "times": pa.nulls(n, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        pair, times = np.unique(text[~common] * max(len(seen), 1) + word[~common], return_counts=True)
        words = pa.array(list(seen), pa.binary())
        for i in range(0, len(pair), 1 << 16):
            some = slice(i, i + (1 << 16))
            at, of = np.divmod(pair[some], len(seen))
            nulls = [pa.nulls(len(at), cols[c].type) for c in ("doc_id", "held_out", "n_tokens", "n_common", "log_common", "score")]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(at)), *nulls, words.take(pa.array(of)), pa.array(times[some])], list(cols))

    kind = docs.schema["doc_id"].dataType.simpleString()
    if at_most:
        met, run = rows, at_once
    else:
        blocks = dealt(rows, order, block_bytes, most, piece_bytes)
        answers = blocks.where("gram is not null").select("block", "gram").join(logs, "gram").select((F.col("block") * 2).alias("key"), "gram", "log")
        waiting = blocks.where("row is not null").select((F.col("block") * 2 + 1).alias("key"), "row", "doc_id", "held_out", "raw")
        met = (waiting.unionByName(answers, allowMissingColumns=True).repartition(partitions(spark), F.shiftright("key", 1))
               .sortWithinPartitions("key"))               # one number as key: sorted by its bits
        run = by_block
    scored = stage(met.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_common bigint, "
                                       "log_common double, score double, word binary, times bigint"), "scored")
    sent.destroy()                                         # nothing reads it again
    counts = words.where(F.col("n") < least)
    others = (scored.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
              .groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"),
                                  F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("log_rare")))
    base = F.col("log_common") + F.coalesce("log_rare", F.lit(0.0)) + log_end - F.col("n_tokens") * log_all
    n_known = F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + (1 if ends else 0)
    return (scored.where("n_tokens is not null").drop("word", "times").join(others, "row", "left")
            .select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                    base.alias("base_score"), "score"))

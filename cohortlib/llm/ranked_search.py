"""Ranked lexical search: Block-Max MaxScore over compressed posting lists.

``build`` cuts the documents into shards of about SHARD_BYTES of text and writes, for each shard and term, one row with the
term's postings in blocks of BLOCK: compressed document numbers and counts, and beside them what bounds a block's scores.
Documents of a shard are numbered by length, so documents of one block are about equally long and the bounds are tight.

``search`` finds each query's ``k`` best documents. In a shard, the lists of a query's terms are ordered by the most they can
add. The lists whose bounds together stay below the score that the worst of the best documents so far has are not
essential: a document that is only in those cannot get in. Candidates come from the essential lists; for each of them the block
maxima of the other lists are added up first, and a block is decompressed only if a candidate can still get in with it. Tasks hand
on the heaps from shard to shard, and the heaps of all tasks are merged in Spark. Nothing is left out: the results
are those of scoring every document.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased. With N the documents that have
a term, L all their terms, n a document's, df the documents that hold a term, tf its count in a document: a term
weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 25 + (75 n N) div L, and its score sums, over the query's
terms with repeats, the weight times (10^9 tf) div (1000 tf + 8 m).

Null and empty texts, and texts without a term, are in no list: they do not count and are never found. Equal scores are
ordered by doc_id, a null id last; repeated rows are documents of their own, and so are repeated rows of the queries. A query
without a known term has no result, and so has every query over an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlib.llm.helpers import chunks, partitions, raw_text, stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES = 1 << 23                                      # of text; bounds what a task holds, when building and when searching
PIECE_BYTES = 1 << 20                                      # of a long text, split into terms at once
BLOCK = 64                                                 # postings
WINDOW = 1 << 11                                           # documents that are scored together
SLICE_ROWS = 1 << 13                                       # of a shard's rows, sent on at once
QUERY_TERMS = 1 << 18                                      # of the queries that are broadcast together
MERGE = 64                                                 # ways in which the heaps of a query are merged first

INDEX = ("shard bigint, term string, n bigint, lasts array<int>, most_tf array<int>, least_n array<int>, payloads array<binary>, "
         "doc_ids array<bigint>, lengths array<bigint>")

#: Bytes of terms in lower case, all others blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    text = raw.translate(_FOLD)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits to a byte, the highest bit set on all but a number's last byte; and the end of each number."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - size
    for k in range(5):
        has = size > k
        low = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = low.astype(np.uint8) | ((size[has] > k + 1) << 7).astype(np.uint8)
    return out, ends


def read_varints(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 128)
    start = np.concatenate(([0], stop[:-1] + 1))
    shift = 7 * (np.arange(len(data)) - np.repeat(start, stop - start + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, start)


def shard_rows(shard: int, doc_ids: list, texts: Iterable[bytes], block: int = BLOCK) -> pa.RecordBatch | None:
    """The index rows of one shard: one without a term, which lists the documents, then one for each term."""
    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    found, lengths = [], []
    for text in texts:
        n = 0
        for words in terms(text):
            found.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
            n += len(words)
        lengths.append(n)
    n_words = np.array(lengths, np.int64)
    held = np.flatnonzero(n_words)
    if not len(held):
        return None
    order = held[np.argsort(n_words[held], kind="stable")]
    number = np.zeros(len(n_words), np.int64)
    number[order] = np.arange(len(order))
    keys = np.concatenate(found).astype(np.int64)
    del found
    keys *= len(order)
    keys += np.repeat(number, n_words)
    keys.sort()
    run = np.flatnonzero(np.diff(keys, prepend=-1))        # equal keys: one posting
    tf, keys = np.diff(run, append=len(keys)), keys[run]
    term, doc = np.divmod(keys, len(order))
    n_words = n_words[order]

    begin = np.searchsorted(term, np.arange(len(vocab)))                 # of each term's list
    within = np.arange(len(term)) - begin[term]
    first = np.flatnonzero(within % block == 0)                          # of each block
    after = np.append(first[1:], len(term))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    data, ends = varints(np.stack((gap, tf), axis=1).ravel())
    cuts = np.concatenate(([0], ends[2 * after - 1])).astype(np.int32)
    payloads = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    per_list = np.concatenate(([0, 0], np.cumsum(np.bincount(term[first], minlength=len(vocab))))).astype(np.int32)
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(per_list), pa.array(values, kind))
    names = pa.array([None, *(t.decode("utf-8", "replace") for t in vocab)], pa.string())
    size = np.concatenate(([len(order)], np.diff(np.append(begin, len(term)))))
    rows = len(names)
    own = lambda values: pa.array([values, *([None] * (rows - 1))], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, shard)), names, pa.array(size), lists(doc[after - 1].astype(np.int32), pa.int32()),
         lists(np.maximum.reduceat(tf, first).astype(np.int32), pa.int32()), lists(np.minimum(n_words[doc[first]], 2**31 - 1).astype(np.int32), pa.int32()),
         pa.ListArray.from_arrays(pa.array(per_list), payloads), own([doc_ids[i] for i in order.tolist()]), own(n_words.tolist())],
        ["shard", "term", "n", "lasts", "most_tf", "least_n", "payloads", "doc_ids", "lengths"])


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder. Nothing is shuffled: a shard is part of one
    input partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for found in chunks(batches, "raw", shard_bytes):
            texts = found.column("raw")
            rows = shard_rows(shard, found.column("doc_id").to_pylist(), (texts[i].as_py() for i in range(len(texts))), block)
            shard += 1
            for start in range(0, rows.num_rows if rows else 0, SLICE_ROWS):
                yield rows.slice(start, SLICE_ROWS)

    return stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw_text().alias("raw")).mapInArrow(run, INDEX), "postings")


EMPTY = np.zeros(0, np.int64)


class Postings:
    """One term's list in a shard; blocks are decompressed when first asked for."""

    def __init__(self, row: dict, m: np.ndarray, of_length):
        self.last, self.payloads, self.m = np.array(row["lasts"]), row["payloads"], m
        self.most = impact(np.array(row["most_tf"], np.int64), of_length(np.array(row["least_n"], np.int64)))
        self.bound = int(self.most.max())
        self.plain: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def blocks_of(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, docs)            # the number of blocks: the document comes after the list's end

    def most_at(self, docs: np.ndarray) -> np.ndarray:
        """The most the list can add to each document."""
        return np.append(self.most, 0)[self.blocks_of(docs)]

    def read(self, blocks: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """The documents of some blocks, in order, and what the term adds to each before its weight."""
        blocks = list(blocks)
        new = [b for b in blocks if b not in self.plain]
        if new:
            data = [np.frombuffer(self.payloads[b], np.uint8) for b in new]
            values, at = read_varints(np.concatenate(data)), 0
            for b, raw in zip(new, data, strict=True):
                end = at + np.count_nonzero(raw < 128)     # numbers end at these bytes, two for each posting
                docs = np.cumsum(values[at:end:2])
                self.plain[b] = docs, impact(values[at + 1:end:2], self.m[docs])
                at = end
        parts = [self.plain[b] for b in blocks]
        return np.concatenate([EMPTY, *(p[0] for p in parts)]), np.concatenate([EMPTY, *(p[1] for p in parts)])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.last, [low, high - 1])
        docs, adds = self.read(range(a, min(b + 1, len(self.last))))
        x, y = np.searchsorted(docs, [low, high])
        return docs[x:y], adds[x:y]

    def adds_to(self, wanted: np.ndarray) -> np.ndarray:
        """What the term adds to each of some documents, in order."""
        out = np.zeros(len(wanted), np.int64)
        block = self.blocks_of(wanted)
        docs, adds = self.read(np.unique(block[block < len(self.last)]).tolist())
        if len(docs):
            at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
            hit = docs[at] == wanted
            out[hit] = adds[at[hit]]
        return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * m)


class Best:
    """The ``k`` best (score, doc_id) so far; a null id, held as the largest number with a flag, comes last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score from which a document may get in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(pair) for pair in ((self.score, score), (self.doc, doc), (self.null, null)))
        top = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[top], doc[top], null[top]


def search_shard(found: list[tuple[Postings, int]], doc: np.ndarray, null: np.ndarray, best: Best, window: int = WINDOW) -> None:
    """Put a shard's best documents for a query, given as lists with weights, into ``best``."""
    found = sorted(((p, w) for p, w in found if w), key=lambda x: x[0].bound * x[1])
    reach = np.cumsum([p.bound * w for p, w in found])
    for low in range(0, len(doc), window):
        high, least = min(low + window, len(doc)), best.least
        split = int(np.searchsorted(reach, least))         # the lists before it add up to less than ``least``
        if split == len(found):
            return
        total = np.zeros(high - low, np.int64)
        for postings, weight in found[split:]:
            docs, adds = postings.between(low, high)
            total[docs - low] += weight * adds
        at = np.flatnonzero(total)
        score, at = total[at], at + low
        most = np.array([w * p.most_at(at) for p, w in found[:split]]).reshape(split, len(at))
        left = most.sum(axis=0)
        for i in range(split - 1, -1, -1):
            stay = score + left >= least
            at, score, left, most = at[stay], score[stay], left[stay], most[:, stay]
            if not len(at):
                break
            left = left - most[i]
            maybe = np.flatnonzero(most[i])
            score[maybe] += found[i][1] * found[i][0].adds_to(at[maybe])
        stay = score >= least
        if stay.any():
            best.add(score[stay], doc[at[stay]], null[at[stay]])


def search(index: DataFrame, queries: DataFrame, k: int = 10, item: str = "item_id", window: int = WINDOW, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` documents that score highest for each row of ``queries`` (item_id, text)."""
    spark = index.sparkSession
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = stage(queries.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"),
                                 F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("words")), "queries")
    words = asked.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = stage(words.select("term").distinct(), "wanted_terms")
    whole = index.where("term is null").agg(F.sum("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    n_docs, n_terms = int(whole[0] or 0), int(whole[1] or 0)
    df = index.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = stage(words.join(df.select("term", weight.alias("weight")), "term").select("q", "term", (F.col("times") * F.col("weight")).alias("weight")),
                    "weighed_terms")
    n_blocks = -(-weighed.count() // query_terms)
    heaps = spark.createDataFrame([], "q bigint, way int, doc_id bigint, score bigint")
    for b in range(n_blocks):                              # usually one: at most about ``query_terms`` weights are broadcast at once
        part = weighed.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b)
        per_query = part.groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
        sent = spark.sparkContext.broadcast([(r.q, [(t.term, t.weight) for t in r.terms]) for r in per_query.collect()])
        lists = index.join(part.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null"))
        placed = lists.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        heaps = heaps.unionByName(placed.mapInArrow(_searcher(sent, n_docs, n_terms, k, window), heaps.schema))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("q", "way").orderBy(*order))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return top.join(asked.select("q", "item"), "q").select(F.col("item").alias(item), "rank", "doc_id", "score")


def _searcher(sent, n_docs: int, n_terms: int, k: int, window: int):
    of_length = lambda n: 25 + 75 * n * n_docs // n_terms

    def shard(rows: list[dict], best: dict[int, Best]) -> None:
        ids = pa.array(rows[0]["doc_ids"], pa.int64())
        null = ids.is_null().to_numpy(zero_copy_only=False)
        doc = ids.fill_null(2**63 - 1).to_numpy()
        m = of_length(np.array(rows[0]["lengths"], np.int64))
        lists = {r["term"]: Postings(r, m, of_length) for r in rows[1:]}
        for q, words in sent.value:
            found = [(lists[t], w) for t, w in words if t in lists]
            if found:
                search_shard(found, doc, null, best[q], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = defaultdict(lambda: Best(k))
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != held[0]["shard"]:
                    shard(held, best)
                    held = []
                held.append(row)
        if held:
            shard(held, best)
        way = TaskContext.get().partitionId() % MERGE
        for q, b in best.items():
            n = len(b.score)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(np.full(n, way, np.int32)), pa.array(b.doc, mask=b.null), pa.array(b.score)],
                                             ["q", "way", "doc_id", "score"])

    return run

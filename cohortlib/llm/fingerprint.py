"""Document fingerprints by winnowing.

A rolling hash runs over every k-gram of code points; from each window of w consecutive hashes the smallest is
kept, the rightmost of equal ones, with its position. Two texts that share at least ``k + w - 1`` code points in a
row share a fingerprint (the match guarantee), and no match shorter than k is ever reported.

Null texts count as empty. An empty text has an empty fingerprint; a text shorter than k has one hash, of the whole
text, at position 0. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import mix64, partitions

K = 25
WINDOW = 26
BASE = np.uint64(0x9E3779B97F4A7C15)                     # odd, so that it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(1 << 14, 1 << (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram: sum(c[i+j] * base**j) modulo 2**64 from running sums, then mixed."""
    n = len(points)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power(BASE, n), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * power(INVERSE, n - k + 1))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    points = code_points(text)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = rolling(points, min(k, len(points)))
    n = len(hashes)
    window = min(window, n)
    best, at, span = hashes, np.arange(n), 1
    while span < window:                                  # minima of twice the span, or of what is left to the window
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        later = right <= left
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, right, left)
        span += step
    kept = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return hashes[kept], kept


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the sets of selected hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A name for a fingerprint: BLAKE2b of its hashes and positions, 32 hex digits."""
    return hashlib.blake2b(hashes.tobytes() + positions.astype(np.int64).tobytes(), digest_size=16).hexdigest()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions of every document; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t, k, window) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                 pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, f"doc_id {ids}, hashes array<bigint>, positions array<bigint>"))


def _blocks(docs: DataFrame, n: int):
    """A column that numbers up to n ranges of descending doc_id, with about as many rows each.

    The driver receives n - 1 ids. They are searched in two steps, so a row costs about 2 * sqrt(n) comparisons."""
    at = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * n))).first()[0] if at else None
    edges = sorted(set(found or []), reverse=True)
    if not edges:
        return F.lit(0), 1
    step = max(1, int(len(edges) ** 0.5))
    parts = [edges[i:i + step] for i in range(0, len(edges), step)]
    kind = docs.schema["doc_id"].dataType
    heads = F.array(*(F.lit(p[0]).cast(kind) for p in parts))
    tails = F.array(*(F.array(*(F.lit(e).cast(kind) for e in p)) for p in parts))
    row = F.size(F.filter(heads, lambda e: e > F.col("doc_id")))
    within = F.size(F.filter(F.element_at(tails, F.greatest(row, F.lit(1))), lambda e: e > F.col("doc_id")))
    block = F.when(F.col("doc_id").isNull(), len(edges)).when(row == 0, 0).otherwise((row - 1) * step + within)
    return block, len(edges) + 1


def compare_neighbours(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Documents stand in descending order of doc_id (rows of one id by descending text, a null id last); the one after
    the last is the first. The edited text has the last floor(n/2) code points replaced by the first as many of the
    next document. Texts are shuffled once, into blocks of neighbouring ids; each block also gets the first row of the
    block after it, so that no other exchange is needed. Rows that share a doc_id stay in one block.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_selected."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    block, n = _blocks(docs, partitions(spark))
    placed = own.withColumn("block", block.cast("int"))
    # The first row of each block in use, wanted by the block in use before it (by the last one for the first).
    first = {r["block"]: r["doc_id"] for r in placed.groupBy("block").agg(F.max("doc_id").alias("doc_id")).collect()}
    used = sorted(first)
    wanted = [(used[i - 1], b, first[b]) for i, b in enumerate(used)]
    heads = spark.createDataFrame(wanted, f"block int, of int, id {docs.schema['doc_id'].dataType.simpleString()}")
    texts = (placed.join(F.broadcast(heads.select(F.col("of").alias("block"), "id")), "block")   # a row for each block
             .where(F.col("doc_id").eqNullSafe(F.col("id")))
             .groupBy("block").agg(F.max("text").alias("text")))
    copies = (heads.join(texts.withColumnRenamed("block", "of"), "of")
              .select(F.col("id").alias("doc_id"), "text", "block", F.lit(False).alias("own")))
    rows = (placed.withColumn("own", F.lit(True)).unionByName(copies).repartitionById(n, F.col("block"))
            .sortWithinPartitions(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None                                     # the row that still waits for the next document

        def result(row, text, hashes):
            doc_id, own_text, own_hashes, name = row
            half = len(own_text) // 2
            edited = own_text[:len(own_text) - half] + text[:half]
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            other, at = winnow(edited, k, window) if edited != own_text else (own_hashes, None)
            return (doc_id, len(own_text), sha, name, name if at is None else digest(other, at),
                    likeness(own_hashes, other), likeness(own_hashes, hashes), len(own_hashes))

        for batch in batches:
            out = []
            for doc_id, text, mine in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                          batch.column("own").to_pylist(), strict=True):
                hashes, at = winnow(text, k, window)
                if before is not None:
                    out.append(result(before, text, hashes))
                before = (doc_id, text, hashes, digest(hashes, at)) if mine else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names)

    id_type = docs.schema["doc_id"].dataType
    types = [pa.int32() if id_type.simpleString() == "int" else pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "n_selected"]
    return rows.select("doc_id", "text", "own").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double, n_selected bigint")

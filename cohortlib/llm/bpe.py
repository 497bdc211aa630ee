"""Byte-level BPE by replaying the merges over many words at once.

The distinct words of a block of documents lie in one array of byte tokens, chained word by word. An inverted index
leads from each mergeable pair (by its rank) to the positions where it stands. The merges are applied in rank order:
all positions of a pair at once, after which only the touched neighbours get new index entries. A block takes a
bounded number of text bytes of one partition, so no word list crosses the network and memory does not grow.

Replaying by rank equals the usual rule (merge the lowest pair of a word, leftmost first) as long as no merge brings
up a pair of a lower rank. Words in which that happens are encoded by the usual rule itself.

Null and empty texts have no tokens. The vocabulary file is a parameter; its size bounds what tasks hold.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from cohortlib.llm.helpers import chunks

BLOCK_BYTES = 4 << 20


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens, self.size = tokens, size
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.fromiter((self.ranks.get(bytes([b]), -1) for b in range(256)), np.int64, 256)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.decimal = [str(i) for i in range(size)]
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge; ids below 0 stand for a word's edge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def plain(self, word: bytes) -> list[int]:
        """The usual rule on one word."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
            lowest = min((x for x in found if x[0] is not None), default=None)
            if lowest is None:
                break
            i = lowest[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and where each word's ids start (one more entry than words)."""
    whole = np.fromiter(map(vocab.ranks.get, words, repeat(-1)), np.int64, len(words))
    split = np.flatnonzero((whole < 0) & (np.fromiter(map(len, words), np.int64, len(words)) > 0))
    counts = np.where(whole >= 0, 1, 0)
    ids, owner, odd = _replay(vocab, [words[i] for i in split.tolist()])
    counts[split] = np.bincount(owner, minlength=len(split)) if len(split) else 0
    exact = {int(split[w]): vocab.plain(words[split[w]]) for w in odd}
    for w, tokens in exact.items():
        counts[w] = len(tokens)
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(starts[-1], np.int64)
    out[starts[:-1][whole >= 0]] = whole[whole >= 0]
    if len(ids):
        keep = ~np.isin(owner, odd) if odd else np.ones(len(owner), bool)
        ids, owner = ids[keep], owner[keep]
        first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(split)))))[:-1]
        out[starts[split[owner]] + np.arange(len(ids)) - first[owner]] = ids
    for w, tokens in exact.items():
        out[starts[w]:starts[w + 1]] = tokens
    return out, starts


def _replay(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Token ids, the word of each, and the words in which a merge brought up a lower pair."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    token = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    ends = np.cumsum(sizes) - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)          # n stands for no neighbour
    after[ends] = n
    before[np.concatenate(([0], ends[:-1] + 1))] = n
    token = np.append(token, -1)                                        # the token of "no neighbour"
    after, before = np.append(after, n), np.append(before, n)
    rank = vocab.rank_of(token, token[after])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(at: np.ndarray) -> None:
        """Index entries for positions whose pair is new."""
        mergeable = rank[at]
        at = at[mergeable >= 0]
        if not len(at):
            return
        mergeable = mergeable[mergeable >= 0]
        order = np.argsort(mergeable, kind="stable")
        at, mergeable = at[order], mergeable[order]
        cuts = np.flatnonzero(mergeable[1:] != mergeable[:-1]) + 1
        first = mergeable[np.concatenate(([0], cuts))].tolist()
        bounds = [0, *cuts.tolist(), len(at)]
        for i, r in enumerate(first):
            piece = at[bounds[i]:bounds[i + 1]]
            if r in index:
                index[r].append(piece)
            else:
                index[r] = [piece]
                heapq.heappush(queue, r)

    note(np.arange(n))
    odd: set[int] = set()
    while queue:
        now = heapq.heappop(queue)
        pieces = index.pop(now)
        at = pieces[0] if len(pieces) == 1 else np.unique(np.concatenate(pieces))
        at = at[rank[at] == now]
        if len(at) > 1:
            overlap = rank[after[at]] == now
            if overlap.any():                             # runs such as aaaa: every second position, from the left
                at = _alternate(np.sort(at), after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        token[at] = now
        after[at] = beyond
        before[beyond] = at                               # the entry of "no neighbour" is never read
        rank[gone] = -1
        left = before[at]
        touched = np.concatenate((at, left[(left < n) & (token[left] != now)]))     # each position once
        rank[touched] = vocab.rank_of(token[touched], token[after[touched]])
        lower = touched[(rank[touched] >= 0) & (rank[touched] < now)]
        if len(lower):
            odd.update(owner[lower].tolist())
        token[gone] = -2                                  # no longer a token
        note(touched)
    alive = token[:n] >= 0
    return token[:n][alive], owner[alive], sorted(odd)


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted positions, drop each that directly follows a kept one."""
    follows = np.zeros(len(at), bool)
    follows[1:] = after[at[:-1]] == at[1:]
    head = np.flatnonzero(~follows)
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    return at[place % 2 == 0]


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes of a row of ids."""
    lengths = vocab.lengths[ids]
    if not len(ids):
        return b""
    ends = np.cumsum(lengths)
    return vocab.bytes[np.repeat(vocab.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def encode_block(vocab: Vocabulary, pattern, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text of a block; words are encoded once for the block."""
    seen: defaultdict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    number = seen.__getitem__
    rows = [np.fromiter(map(number, pattern.findall(t)), np.int64) for t in texts]
    ids, starts = encode_words(vocab, [w.encode("utf-8", "surrogatepass") for w in seen])
    sizes = np.diff(starts)
    for row in rows:
        if not len(row):
            yield np.empty(0, np.int64)
            continue
        n = sizes[row]
        ends = np.cumsum(n)
        yield ids[np.repeat(starts[row] - (ends - n), n) + np.arange(ends[-1])]


@lru_cache(maxsize=4)
def _loaded(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as f:
        return Vocabulary(f.read())


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to all executors; returns its name there."""
    name = path.rpartition("/")[2]
    if name not in {f.rpartition("/")[2] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def _digests(vocab: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    decimal = " ".join(map(vocab.decimal.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decode(vocab, ids)).hexdigest()


ADDED = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` but the text, which gives way to ids (array<int>), n_tokens, ids_sha256 and decoded_sha256.

    A column of one of these names gives way too. Nothing is shuffled."""
    name = _shipped(docs.sparkSession, path)
    rest = [c for c in docs.columns if c.lower() not in ("text", *ADDED)]
    kept = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = _loaded(name), regex.compile(pattern)
        for block in chunks(batches, "text", block_bytes):
            texts = [t.decode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()]
            rows = list(encode_block(vocab, split, texts))
            ends = np.cumsum([0, *map(len, rows)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).astype(np.int32)))
            made = [_digests(vocab, r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in rest), ids, pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())], [*rest, *ADDED])

    schema = (StructType([*kept.drop("text").schema.fields]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType())
              .add("ids_sha256", StringType()).add("decoded_sha256", StringType()))
    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode, decode again, and return doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    return encoded(docs.select("doc_id", "text"), path, pattern, block_bytes).drop("ids")

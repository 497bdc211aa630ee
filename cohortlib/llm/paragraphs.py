"""Substring dedup: near-equal paragraphs are found by MinHash banding and removed from all documents but one.

A paragraph is the smallest unit a passage is quoted by: a line, a sentence, or a clause between punctuation marks. So a
passage pasted into the middle of another text still shares all its paragraphs but the first with the other places.

Paragraphs of five words and more get a MinHash of their word shingles, cut into bands (``tune`` picks how many for the
recall wanted). Paragraphs that collide in a band are compared by the exact Jaccard likeness of their shingles; those
at the threshold or above are linked, and connected components are the clusters. Of each cluster the first occurrence
stays (smallest document, then place), the others are candidates. Each is extended by the words beside it that are
the same beside the kept occurrence, so too short paragraphs and parts of clauses that merge with a host's words
belong to it. Runs that belong to one kept passage are joined over edited words between them, if the whole has
the Jaccard likeness of the threshold and the edit is small: at most EDIT words, and at most SLACK more than the kept passage has
at that place. A run of matched words is removed if it has ``least_words`` words or more; single short sentences that
texts share by chance stay, and so does every word that the kept occurrence does not have at that place, but for such edits.

Equal paragraphs are one node, whatever their number, and what a task finds in a bucket is sent on as stars; no bucket,
cluster or document is gathered beyond a bounded unit. Null texts count as empty and stay as they are. Rows that share
both doc_id and text count as one document. A null doc_id comes last when the occurrence to keep is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from cohortlib.llm.components import components, local_stars
from cohortlib.llm.fingerprint import BASE, INVERSE, power
from cohortlib.llm.helpers import WORD, chunks, delete, fresh, mix64, n_written, raw_text, runs, stage, written_since

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
LEAST_WORDS = 25
BLOCK_BYTES = 1 << 20                                      # its arrays take some fifty times as much
HOT = 1 << 12
TILE = 512
BLOOM_WORDS = 1 << 20                                      # 8 MB, whatever the number of entries
LONG = 24
CUT = 8
EDIT = 8                                                   # words of its own that a copy may have between two matched runs
SLACK = 2                                                  # of them beyond those that the kept passage has there


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK, _LINE, _MARK = _table(b" \t\n\v\f\r"), _table(b"\n\r"), _table(b".,;:!?")


def tune(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """The least number of bands of ``rows`` hashes that finds a pair at ``similarity`` with chance ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))


@dataclass
class Units:
    """The paragraphs of a block of texts, and the words they are made of.

    ``text``, ``number`` (within its text), ``start`` (byte in its text), ``size`` (words) and ``first`` (its first word in
    the block) have an entry for each paragraph, ``word`` has a hash for each word."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    word: np.ndarray

    def names(self) -> np.ndarray:
        """A hash of each paragraph's words in their order."""
        ahead = np.concatenate(([np.uint64(0)], np.cumsum(self.word * power(BASE, len(self.word)), dtype=np.uint64)))
        total = (ahead[self.first + self.size] - ahead[self.first]) * power(INVERSE, len(self.word) + 1)[self.first]
        return mix64(total + self.size.astype(np.uint64))

    def shingles(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word shingles of some paragraphs in a row, and where each paragraph's start."""
        per = self.size[of] - (SHINGLE - 1)
        begin = np.concatenate(([0], np.cumsum(per)[:-1])) if len(of) else np.empty(0, np.int64)
        at = np.repeat(self.first[of] - begin, per) + np.arange(int(per.sum()))
        value = np.zeros(len(at), np.uint64)
        for i in range(SHINGLE):
            value = value * BASE + self.word[at + i]
        return mix64(value), begin


def _words(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """The lower-cased texts in a row, where each text starts, where words start and end, and a hash of each word."""
    flat = np.frombuffer(b"\n".join([*raws, b""]).lower(), np.uint8)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)))
    blank = _BLANK[flat]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1      # where words begin and end; each text ends in a line feed
    edges = turn if not len(flat) or blank[0] else np.concatenate(([0], turn))
    starts, ends = edges[0::2], edges[1::2]
    ahead = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power(BASE, len(flat)), dtype=np.uint64)))
    word = mix64((ahead[ends] - ahead[starts]) * power(INVERSE, len(flat) + 1)[starts])
    return flat, at, starts, ends, word


def whole(raws: list[bytes]) -> Units:
    """Texts as one unit each, however long; texts without a word have none."""
    _, at, starts, _, word = _words(raws)
    text, first = np.unique(np.searchsorted(at, starts, "right") - 1, return_index=True)
    return Units(text, np.zeros(len(text), np.int64), starts[first] - at[text], np.diff(np.append(first, len(starts))), first, word)


def units(raws: list[bytes]) -> Units:
    """Cut texts into paragraphs. Everything is done for the whole block at once.

    A paragraph begins with the first word of a text or line, and behind a word that ends in a punctuation mark. One of
    over LONG words, such as text without punctuation, is cut behind every word whose hash is a multiple of CUT. All cuts
    follow from the words themselves, so they fall alike wherever a passage stands."""
    flat, at, starts, ends, word = _words(raws)
    lines = np.concatenate(([0], np.cumsum(_LINE[flat], dtype=np.int64)))
    new = np.ones(len(starts), bool)
    new[1:] = _MARK[flat[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    long = np.repeat(size > LONG, size)
    new[1:] |= long[:-1] & (word[:-1] % np.uint64(CUT) == 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    text = np.searchsorted(at, starts[first], "right") - 1
    number = np.arange(len(first)) - np.searchsorted(text, text, "left")
    return Units(text, number, starts[first] - at[text], size, first, word)


def band_keys(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> list[np.ndarray]:
    """A key for each band and paragraph, from ``rows`` minima each."""
    out = []
    for band in range(bands):
        key = np.full(len(first), np.uint64(band + 1))
        for row in range(rows):
            seed = mix64(np.array([band * rows + row + 1], np.uint64))[0]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(mix64(shingles ^ seed), first))
        out.append(key)
    return out


def occurrences(docs: DataFrame, bands: int, rows: int = 1) -> DataFrame:
    """doc_id, text_hash, number, paragraph (a hash of its words) and the band keys of every paragraph of five words and more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", BLOCK_BYTES):
            found = units(block.column("raw").to_pylist())
            of = np.flatnonzero(found.size >= SHINGLE)
            if not len(of):
                continue
            keys = band_keys(*found.shingles(of), bands, rows)
            at = pa.array(found.text[of])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(at), block.column("text_hash").take(at), pa.array(found.number[of].astype(np.int32)),
                 pa.array(found.names()[of].view(np.int64)), *(pa.array(k.view(np.int64)) for k in keys)],
                ["doc_id", "text_hash", "number", "paragraph", *(f"key{i}" for i in range(bands))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), raw_text().alias("raw"))
            .mapInArrow(run, f"doc_id {kind}, text_hash bigint, number int, paragraph bigint, "
                        + ", ".join(f"key{i} bigint" for i in range(bands))))


def bloom(values: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size over a column of hashes, built by bitwise or in Spark."""
    spots = F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit(64 * BLOOM_WORDS - 1)) for s in (0, 26)))).alias("spot")
    got = (values.select(spots).groupBy(F.shiftright("spot", 6).alias("word"))
           .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(BLOOM_WORDS, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    hit = np.ones(len(values), bool)
    for shift in (0, 26):
        spot = (values >> np.uint64(shift)) & np.uint64(64 * BLOOM_WORDS - 1)
        hit &= (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return hit


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """paragraph, shingles (a set, sorted) of the wanted paragraphs. A filter of bounded size lets through few others,
    which the join then drops."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "paragraph"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", BLOCK_BYTES):
            found = units(block.column("raw").to_pylist())
            names = found.names()
            hit = np.flatnonzero(in_bloom(sent.value, names) & (found.size >= SHINGLE))
            hit = hit[np.unique(names[hit], return_index=True)[1]]
            if len(hit):
                values, begin = found.shingles(hit)
                sets = [np.unique(v).view(np.int64) for v in np.split(values, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names[hit].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))],
                                                 ["paragraph", "shingles"])

    found = docs.select(raw_text().alias("raw")).mapInArrow(run, "paragraph bigint, shingles array<bigint>")
    return found.join(wanted, "paragraph", "left_semi").groupBy("paragraph").agg(F.first("shingles").alias("shingles"))


def alike(sets: list[np.ndarray], groups: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (by number) with exact Jaccard likeness at or above ``similarity``; with ``groups`` only between different ones."""
    n = len(sets)
    if n <= 8:
        pairs = [(i, j) for i, j in combinations(range(n), 2) if groups is None or groups[i] != groups[j]]
        good = []
        for i, j in pairs:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                good.append((i, j))
        return np.array([i for i, _ in good], np.int64), np.array([j for _, j in good], np.int64)
    sizes = np.array([len(s) for s in sets])
    left, right = [], []
    for a in range(0, n, TILE):
        rows = sets[a:a + TILE]
        known, flat = np.unique(np.concatenate(rows), return_inverse=True)
        one = _matrix(flat, [len(s) for s in rows], len(known))
        for b in range(a, n, TILE):
            cols = sets[b:b + TILE]
            joined = np.concatenate(cols)
            at = np.minimum(np.searchsorted(known, joined), len(known) - 1)
            two = _matrix(np.where(known[at] == joined, at, len(known)), [len(s) for s in cols], len(known))
            both = one @ two.T
            i, j = np.nonzero(both >= similarity * (sizes[a:a + TILE, None] + sizes[None, b:b + TILE] - both) - 1e-6)
            i, j = i + a, j + b
            keep = (i < j) if groups is None else (i < j) & (groups[i] != groups[j])
            left.append(i[keep])
            right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _matrix(columns: np.ndarray, lengths: list[int], width: int) -> np.ndarray:
    """0/1 rows; entries at ``width`` fall away."""
    out = np.zeros((len(lengths), width + 1), np.float32)
    out[np.repeat(np.arange(len(lengths)), lengths), columns] = 1
    return out[:, :width]


def links(docs: DataFrame, seen: DataFrame, bands: int, similarity: float, hot: int = HOT) -> DataFrame:
    """a, b: stars that connect the paragraphs that collide in a band and are alike.

    A bucket of up to ``hot`` different paragraphs is one unit. More are dealt at random into groups of hot / 2, and every
    pair of groups is a unit of its own. All pairs of a bucket are compared either way."""
    keys = F.explode(F.array(*(f"key{i}" for i in range(bands)))).alias("key")
    pairs = seen.select("paragraph", keys).distinct()
    shared = stage(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_keys")
    groups = F.when(F.col("n") > hot, F.ceil(F.col("n") / (hot / 2))).otherwise(1).cast("int").alias("groups")
    members = stage(pairs.join(shared.select("key", groups), "key"), "members")
    sets = stage(shingle_sets(docs, stage(members.select("paragraph").distinct(), "wanted")), "shingle_sets")
    both = F.transform(F.sequence(F.lit(0), F.col("groups") - 1),
                       lambda g: F.struct(F.least(g, "own").alias("one"), F.greatest(g, "own").alias("two")))
    units = (members.withColumn("own", F.pmod(F.xxhash64("paragraph"), "groups").cast("int"))
             .select("paragraph", "key", "own", F.explode(both).alias("unit")).join(sets, "paragraph")
             .select("key", "unit.one", "unit.two", "own", "paragraph", "shingles")
             .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "own", "paragraph"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one, two, own, names, shingles in runs(batches, 3):
            i, j = alike(list(shingles), own if one[0] != two[0] else None, similarity)
            if len(i):
                a, b = local_stars(names[i], names[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return units.mapInArrow(run, "a bigint, b bigint")


def candidates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> DataFrame:
    """doc_id, text_hash, numbers: the paragraphs of a document that occur earlier, in it or in another document."""
    bands = tune(similarity, recall, rows)
    seen = stage(occurrences(docs, bands, rows), "paragraphs")
    roots = components(links(docs, seen, bands, similarity))
    again = seen.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("paragraph", F.col("paragraph").alias("same"))
    nodes = (again.join(roots.withColumnRenamed("node", "paragraph"), "paragraph", "full")
             .select("paragraph", F.coalesce("root", "same").alias("cluster")))
    tops = roots.select(F.col("root").alias("paragraph"), F.col("root").alias("cluster"))       # roots that occur only once
    nodes = stage(nodes.unionByName(tops).distinct(), "clusters")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "number").alias("place")
    held = contexts(docs, nodes).join(nodes, "paragraph").select("cluster", place, "at", "size", "before", "after")
    held = stage(held, "clustered")                        # repeated rows are equal here, and one entry of the sets below
    first = stage(held.groupBy("cluster").agg(F.min(F.struct("place", "at", "size", "before", "after")).alias("first")), "kept_paragraphs")
    out = held.join(first, "cluster").where(F.col("place") != F.col("first.place"))

    def matched(side: str):
        """How many words beside the paragraph are the same as beside the kept one, nearest first."""
        same = F.zip_with(side, f"first.{side}", lambda x, y: x.eqNullSafe(y))
        return F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")

    entry = F.struct("place.number", matched("before").alias("left"), matched("after").alias("right"),
                     F.xxhash64("first.place.doc_id", "first.place.text_hash").alias("kept"), F.col("first.at").alias("at"),
                     F.col("first.size").alias("size"))
    return out.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set(entry).alias("numbers"))


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_hash, number, paragraph, at (its first word's place in the text), size, and hashes of the words before and
    after it, nearest first, up to the far end of the next paragraph of five words and more, and over LONG words at least:
    a clause that is whole in one text may be cut in the other."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "paragraph"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "raw", BLOCK_BYTES):
            found = units(block.column("raw").to_pylist())
            names, large = found.names(), np.flatnonzero(found.size >= SHINGLE)
            hit = np.flatnonzero(in_bloom(sent.value, names[large]))
            of = large[hit]
            if not len(of):
                continue
            text = found.text
            head = found.first[np.searchsorted(text, text[of], "left")]                 # of the text
            last = np.searchsorted(text, text[of], "right") - 1
            tail = found.first[last] + found.size[last]
            up, down = np.append(large, -1)[hit - 1], np.append(large, -1)[hit + 1]      # large neighbours, maybe of other texts
            up_ok, down_ok = (hit > 0) & (text[up] == text[of]), (down >= 0) & (text[down] == text[of])
            begin, end = np.where(up_ok, found.first[up], head), np.where(down_ok, found.first[down] + found.size[down], tail)
            start, stop = found.first[of], found.first[of] + found.size[of]
            begin, end = np.maximum(head, np.minimum(begin, start - LONG)), np.minimum(tail, np.maximum(end, stop + LONG))
            word = (found.word >> np.uint64(32)).astype(np.uint32).view(np.int32)
            before = pa.array([word[a:b][::-1] for a, b in zip(begin.tolist(), start.tolist(), strict=True)], pa.list_(pa.int32()))
            after = pa.array([word[a:b] for a, b in zip(stop.tolist(), end.tolist(), strict=True)], pa.list_(pa.int32()))
            at = pa.array(text[of])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(at), block.column("text_hash").take(at), pa.array(found.number[of].astype(np.int32)),
                 pa.array(names[of].view(np.int64)), pa.array(start - head), pa.array(found.size[of]), before, after],
                ["doc_id", "text_hash", "number", "paragraph", "at", "size", "before", "after"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), raw_text().alias("raw"))
            .mapInArrow(run, f"doc_id {kind}, text_hash bigint, number int, paragraph bigint, at bigint, size bigint, "
                        "before array<int>, after array<int>"))


@dataclass
class _Run:
    """Words start .. stop of a text; of them matched, and the words and shared shingles of the kept passage.

    ``head`` and ``tail`` name the kept text of its first and last candidate, and how far places in it are ahead."""

    start: int
    stop: int
    matched: int
    others: int
    shared: int
    head: tuple
    tail: tuple

    def bridged(self, after: _Run, similarity: float) -> _Run | None:
        """Both runs with what lies between, if that is a small edit of what stands between them in the kept text, and all is alike."""
        gap = after.start + after.head[1] - self.stop - self.tail[1]
        own = after.start - self.stop
        if self.tail[0] is None or self.tail[0] != after.head[0] or gap < 0 or own > min(EDIT, gap + SLACK):
            return None
        both = _Run(self.start, after.stop, self.matched + after.matched, self.others + gap + after.others,
                    self.shared + after.shared, self.head, after.tail)
        total = both.stop - both.start + both.others - 2 * (SHINGLE - 1)
        return both if both.shared >= similarity * (total - both.shared) else None


def cut(raw: bytes, numbers: list, least_words: int, similarity: float = SIMILARITY) -> tuple[bytes, int, int]:
    """The text without its runs of matched words; paragraphs removed in whole or part, and removed words.

    Runs are bridged over edited words where both sides and the words between stay alike to one kept passage.

    ``numbers`` has candidates, each a number or (number, words matched before, words matched after, kept text, place of the
    kept paragraph in it, its size). A document's candidates are held together, as its text is."""
    found = units([raw])
    *_, starts, _, word = _words([raw])
    spans = []
    for entry in numbers:
        number, left, right, kept, place, _ = (entry, 0, 0, None, 0, 0) if isinstance(entry, int) else entry.values()
        a, b = int(found.first[number]), int(found.first[number] + found.size[number])
        spans.append(_Run(a - left, b + right, b + right - a + left, b + right - a + left, 0, (kept, place - a), (kept, place - a)))
    run: list[_Run] = []
    for x in sorted(spans, key=lambda x: (x.start, x.stop)):
        if run and x.start <= run[-1].stop:
            if x.stop > run[-1].stop:
                run[-1].stop, run[-1].tail = x.stop, x.tail
        else:
            run.append(x)
    for x in run:
        x.matched = x.others = x.stop - x.start
        x.shared = max(0, x.matched - (SHINGLE - 1))
    before = 0
    while before != len(run):                              # bridges may make longer ones possible
        before, joined_ = len(run), run[:1]
        for x in run[1:]:
            both = joined_[-1].bridged(x, similarity)
            joined_[-1:] = [both] if both else [joined_[-1], x]
        run = joined_
    gone = np.zeros(len(word), bool)
    for x in run:
        if x.matched >= least_words:
            gone[x.start:x.stop] = True
    if not gone.any():
        return raw, 0, 0
    at = [*starts.tolist(), len(raw)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8))).tolist()     # kept words: from, to
    kept = b"".join([raw[:at[0]], *(raw[at[i]:at[j]] for i, j in zip(edges[::2], edges[1::2], strict=True))])
    return kept, int(np.logical_or.reduceat(gone, found.first).sum()), int(gone.sum())


ADDED = ("n_removed", "removed_words")


def dedup(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their texts cut, and n_removed and removed_words beside all other columns.

    A column of one of these names gives way. Documents without a removal keep their text as it is, a null included."""
    return _cut_all(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED)), ADDED, similarity, recall, least_words)


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their texts cut and all other columns as they were. A document of which nothing but
    white space is left goes; documents without a removal stay as they are."""
    added = fresh(docs, *ADDED)
    out = _cut_all(docs, added, similarity, recall, least_words)
    return out.where((F.col(added[0]) == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def _cut_all(docs: DataFrame, added, similarity: float, recall: float, least_words: int) -> DataFrame:
    hashed, doc, numbers, other = fresh(docs, "text_hash", "doc", "numbers", "other_hash")
    mark = n_written()
    lists = candidates(docs, similarity, recall).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(other), F.col("numbers").alias(numbers))
    steps = written_since(mark)
    lists = stage(lists, "removals")
    delete(docs.sparkSession, steps)                       # the tables it came from; without them the disk holds the texts' exchange alone
    joined = (docs.withColumn(hashed, F.xxhash64("text"))
              .join(lists, (F.col(hashed) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left").select(*docs.columns, numbers))
    names = list(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [cut(t.encode("utf-8", "surrogatepass"), n, least_words, similarity) if t and n else (None, 0, 0)
                   for t, n in zip(texts, batch.column(len(names)).to_pylist(), strict=True)]
            new = [o[0].decode("utf-8", "surrogatepass") if o[1] else t for o, t in zip(out, texts, strict=True)]
            cols = list(batch.columns[:len(names)])
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2))], [*names, *added])

    schema = StructType([*docs.schema.fields])
    for c in added:
        schema = schema.add(c, LongType())
    return joined.mapInArrow(run, schema)

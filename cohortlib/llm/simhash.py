"""SimHash near-duplicates: fingerprints of word shingles, all pairs within a radius, and their components.

Pairs come from an exact tiled comparison: tiles of fingerprints meet by exclusive-or and bit counts, and tile pairs
whose population counts differ by more than the radius are skipped, as the population counts of two fingerprints
differ by no more than their distance. To lay out the tiles, the 64 bits are cut into radius + 1 parts: two
fingerprints within the radius agree in one part at least, so only fingerprints that share a part are laid
out together. That loses no pair, and the work stays far below all pairs of the corpus.

Only distinct fingerprints are compared; documents of one fingerprint belong together anyway. Tasks send on the links
they find as stars, so a group of n near copies makes about n links, not n * n.

Null, empty and blank texts have the fingerprint zero and are linked like any other. Texts with fewer words than a
shingle count as one shingle. Repeated rows share a fingerprint, hence a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from cohortlib.llm.components import components, local_stars
from cohortlib.llm.helpers import fresh, raw_text, runs, stage

SEED = 42
TILE = 512
HOT = 1 << 15                                              # more fingerprints in one part are dealt out as tile pairs
_CUT = 1 << 16
_MOST_HELD = 1 << 20


def fingerprint(raw: bytes, words: int = 3) -> int:
    """SimHash of a text's shingles: a bit is set if it is set in over half of the shingles' XXH64."""
    found = raw.lower().split()                            # bytes: only A-Z, only ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    words = min(words, len(found))
    digest = xxhash.xxh64_digest
    pieces = zip(starts[:len(starts) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pieces]), np.uint8).reshape(-1, 8)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CUT):                  # bounded memory for texts of any length
        set_bits += np.unpackbits(hashes[i:i + _CUT], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, name: str = "fingerprint", words: int = 3) -> DataFrame:
    """The rows of ``docs`` with a 64-bit fingerprint (as a signed number)."""
    (text,) = fresh(docs, "raw")
    rest = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array(found.view(np.int64))], [*rest, name])

    schema = StructType([*docs.schema.fields]).add(name, LongType())
    return docs.withColumn(text, raw_text()).mapInArrow(run, schema)


def near(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links between a and b (within a, if b is None); each sorted by population count.

    Pairs found are cut down to stars as they pile up, so memory stays in proportion to the fingerprints."""
    within = b is None
    b = a if within else b
    pop_a, pop_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    left, right, held = [], [], 0
    for i in range(0, len(a), tile):
        x = a[i:i + tile]
        low, high = pop_a[i] - radius, pop_a[i + len(x) - 1] + radius
        for j in range(i if within else 0, len(b), tile):
            y = b[j:j + tile]
            if pop_b[j] > high:
                break
            if pop_b[j + len(y) - 1] < low:
                continue                                   # population counts too far apart for any pair
            at, to = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            left.append(x[at])
            right.append(y[to])
            held += len(at)
            if held > _MOST_HELD:
                stars = local_stars(np.concatenate(left), np.concatenate(right))
                left, right, held = [stars[0]], [stars[1]], 0
    if not held and not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return local_stars(np.concatenate(left), np.concatenate(right))


def parts(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 bit ranges that cover all 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, (1 << (hi - lo)) - 1 if hi - lo < 64 else -1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """a, b: stars of links that connect all fingerprints within the radius of each other.

    ``distinct`` has one column, fingerprint, without repetition. The fingerprints that share a part value form one
    unit of tiles. More than ``hot`` of them are dealt at random into groups of about hot / 2, and each pair of groups is
    a unit of its own, so that no task grows with the corpus. All pairs are compared either way."""
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fingerprint", lo).bitwiseAND(F.lit(mask)).alias("value"))
                     for i, (lo, mask) in enumerate(parts(radius))))
    laid = distinct.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.part", "k.value")
    groups = F.when(F.col("n") > hot, F.ceil(F.col("n") / (hot / 2))).otherwise(1).cast("int").alias("groups")
    shared = stage(laid.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "value", groups),
                   "shared_parts")
    dealt = laid.join(shared, ["part", "value"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), "groups").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1),
                        lambda g: F.struct(F.least(g, "own").alias("one"), F.greatest(g, "own").alias("two")))
    units = (dealt.select("fingerprint", "part", "value", "own", F.explode(pairs).alias("unit"))
             .select("part", "value", "unit.one", "unit.two", "own", F.bit_count("fingerprint").alias("pop"), "fingerprint")
             .repartition("part", "value", "one", "two").sortWithinPartitions("part", "value", "one", "two", "own", "pop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, one, two, own, prints in runs(batches, 4):
            prints = prints.view(np.uint64)
            if one[0] == two[0]:
                a, b = near(prints, None, radius)
            else:
                cut = int(np.searchsorted(own, one[0], "right"))
                a, b = near(prints[:cut], prints[cut:], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return units.drop("pop").mapInArrow(run, "a bigint, b bigint")


def classes(printed: DataFrame, radius: int = 2, key: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """fingerprint, root, component_id: for each fingerprint its component and the smallest key of all documents in it.

    Only ``root`` tells components apart: keys may be null or repeated."""
    per = stage(printed.groupBy(F.col(name).alias("fingerprint")).agg(F.min(key).alias("low")), "distinct")
    roots = components(links(per.select("fingerprint"), radius))
    placed = per.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return stage(placed.join(lows, "root").select("fingerprint", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links lead to) of every row.

    A row with a null doc_id is linked like any other but never names a component, unless all its component has null."""
    printed = stage(fingerprints(docs.select("doc_id", "text"), words=words).select("doc_id", "fingerprint"), "fingerprints")
    named = printed.join(classes(printed, radius), "fingerprint")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """The documents without near copies: of each component one row stays, with the smallest doc_id.

    Of rows that share that doc_id the one with the smallest fingerprint and row number stays. All columns are kept."""
    name, row = fresh(docs, "fingerprint", "row")
    printed = stage(fingerprints(docs, name, words).withColumn(row, F.monotonically_increasing_id()), "printed")
    slim = printed.select("doc_id", F.col(name).alias("fingerprint"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint", "row")).alias("first")
    named = slim.join(classes(slim, radius), "fingerprint")
    stay = stage(named.groupBy("root").agg(first).select(F.col("first.row").alias(row)), "kept_rows")
    return printed.join(stay, row, "left_semi").select(*docs.columns)

"""Repair of conversation structure at the least cost, by dynamic programming over checkpoints.

The rows of a conversation are taken by turn, null turns first; rows of one turn by role and then by a digest of role and
text, equal rows being one another's copies. A row is blank (nothing but ASCII white space), else a duplicate (its role and text
stand earlier in the conversation), else truncated (its last visible character is none of ``.!?``), else sound. A null role or
text counts as one space. A conversation is well formed if its roles' initials are ``(s?(ua)+)?``. Edits of a row are Keep (0), Rerole to
user or assistant (1) and Delete (2, the only choice for blank rows and duplicates); Insert (5) puts an empty turn of
user or assistant anywhere, and a truncated row that is not deleted costs 5 more. Of the cheapest edits the ASCII-least initials win.

How a conversation stands is one of four states: nothing yet, after a system turn, after user, after assistant. Backwards, each
row turns the costs of finishing from each state after it into those before it. These vectors are kept only at checkpoints, the
square root of the rows apart; walking forward, each block's vectors are computed again and the least tight edit is taken.

A conversation may be of any length. Equal rows are counted first, the rest is range-partitioned in order, and each
partition's part of a conversation is a segment. Only a partition's first and last segment can belong to a conversation that
goes on elsewhere. For these the costs from each state to each state make a 4 x 4 matrix; the matrices of a conversation (at most one a
partition) give the vector at the end of each segment, so that each walks alone, from all four states, and
the walks are strung together in the end. A task holds the initials and faults of one partition's rows, copies included, and the edits of
a conversation, a letter a row, are one string.

Null ids are a conversation of their own; repeated rows are rows like all others; an empty table gives empty results. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import partitions, stage

BLANKS = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, GONE = 0, 1, 2                           # a row as the costs see it; GONE: blank or duplicate

#: States: 0 nothing yet, 1 after a system turn, 2 after user, 3 after assistant. NEXT is the state after a turn of user or
#: assistant, whichever is due; KEPT the state after a turn that keeps its role, by the role's initial.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
TURN = {2: "user", 3: "assistant"}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
FAR = 1 << 40
END = (0, 2 * INSERT, INSERT, 0)                           # costs of ending a conversation in each state

Vector = tuple[int, ...]


@lru_cache(1 << 16)
def before(initial: str, fault: int, after: Vector) -> tuple[Vector, int]:
    """Costs of finishing from each state before a row, less their minimum, and this minimum. ``after`` are those after it."""
    extra = CUT if fault == TRUNCATED else 0
    costs = []
    for s in range(4):
        ways = [DELETE + after[s]]
        if fault != GONE:
            kept = KEPT.get(initial, (None,) * 4)[s]
            ways += [REROLE + extra + after[NEXT[s]]] + ([extra + after[kept]] if kept else [])
        costs.append(min(ways))
    a, b = costs[2], costs[3]                              # then what inserted turns make cheaper
    costs[2], costs[3] = min(a, b + INSERT), min(b, a + INSERT)
    costs = [min(c, INSERT + costs[NEXT[s]], FAR) for s, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(1 << 16)
def edits(initial: str, fault: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with a row, and the state after it."""
    here, least = before(initial, fault, after)
    extra = CUT if fault == TRUNCATED else 0
    out = ""
    while True:
        left = least + here[state]
        if DELETE + after[state] == left:
            return out + "D", state
        if INSERT + here[NEXT[state]] == here[state]:
            out, state = out + "I", NEXT[state]
            continue
        kept = KEPT.get(initial, (None,) * 4)[state]
        return (out + "K", kept) if kept and extra + after[kept] == left else (out + "R", NEXT[state])


Row = tuple[str, int]                                      # initial of the role, fault


def backward(rows: list[Row], end: Vector) -> tuple[Vector, int]:
    """Costs before the first of some rows, and their minimum added up."""
    total = 0
    for initial, fault in reversed(rows):
        end, least = before(initial, fault, end)
        total += least
    return end, total


def walk(rows: list[Row], end: Vector, state: int) -> tuple[str, int]:
    """The edits of some rows from a state on, given the costs after them, and the state they lead to."""
    step = isqrt(len(rows)) + 1
    starts = list(range(0, len(rows), step))
    marks = [end]
    for start in reversed(starts[1:]):                     # vectors at the checkpoints only
        marks.append(backward(rows[start:start + step], marks[-1])[0])
    out = []
    for start, mark in zip(starts, reversed(marks), strict=False):
        block = rows[start:start + step]
        after = [mark]
        for initial, fault in reversed(block[1:]):
            after.append(before(initial, fault, after[-1])[0])
        for (initial, fault), vector in zip(block, reversed(after), strict=True):
            done, state = edits(initial, fault, vector, state)
            out.append(done)
    return "".join(out), state


def closing(state: int) -> str:
    """Turns to insert after the last row."""
    return "I" * (END[state] // INSERT)


def matrix(rows: list[Row]) -> list[int]:
    """Costs from each state before some rows (rows of the matrix) to each state right after them."""
    columns = []
    for t in range(4):
        vector, total = backward(rows, tuple(0 if s == t else FAR for s in range(4)))
        columns.append([min(total + x, FAR) for x in vector])
    return [columns[t][s] for s in range(4) for t in range(4)]


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows (conv_id, turn, role, same, text, n copies, kind), and the same without text in order over range partitions
    (part): sorted by conv_id, turn, role, same, with ``seen`` set where an earlier turn has the same role and text."""
    known = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(end == "", GONE).when(F.right(end, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    known = known.select("*", same.alias("same"), kind.alias("kind"))
    distinct = stage(known.groupBy("conv_id", "turn", "role", "same", "kind").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")),
                     "turns")
    slim = distinct.drop("text")
    first = slim.groupBy("conv_id", "same").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("same").alias("alike"), "first")
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("alike")), "left")
    seen = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")) & F.col("first").isNotNull(), F.lit(False))
    slim = slim.select("conv_id", "turn", "role", "same", "kind", "n", seen.alias("seen"))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "same")]
    slim = slim.repartitionByRange(partitions(rows.sparkSession), *by).withColumn("part", F.spark_partition_id())
    return distinct, stage(slim, "ordered_turns")


def by_part(rows: DataFrame, *more: str) -> DataFrame:
    """Rows in order, a part whole in one task."""
    by = [F.col(c).asc_nulls_first() for c in ("part", "conv_id", *more, "turn", "role", "same")]
    return rows.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions(*by)


def dicts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


SEGMENT = ("part int, conv_id {id}, whole boolean, rows binary, costs array<bigint>, audit string, cost bigint, blank bigint, duplicate bigint, "
           "truncated bigint, illegal bigint, turns bigint, first_turn {turn}, last_turn {turn}, first_role string, last_role string")


def segment(part: int, conv_id, found: Iterable[dict]) -> tuple[dict, list[Row]]:
    """The counts of a segment, and its rows as the costs see them."""
    rows: list[Row] = []
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"part": part, "conv_id": conv_id}
    low = high = None
    for r in found:
        initial = r["role"][:1]
        own = 0 if r["kind"] == GONE or r["seen"] else 1
        if rows and (rows[-1][0], initial) not in LEGAL:
            out["illegal"] += 1
        out["illegal"] += r["n"] - 1
        out["blank" if r["kind"] == GONE else "duplicate"] += r["n"] - own
        out["truncated"] += own * (r["kind"] == TRUNCATED)
        out["turns"] += r["turn"] is not None and r["turn"] != high
        rows += [(initial, r["kind"])] * own + [(initial, GONE)] * (r["n"] - own)
        high = r["turn"]
        low = high if low is None else low
    return out | {"first_turn": low, "last_turn": high, "first_role": rows[0][0], "last_role": rows[-1][0]}, rows


def packed(rows: list[Row]) -> bytes:
    return bytes((("sua".index(i) if i in KEPT else 3) * 3 + f) for i, f in rows)


def unpacked(data: bytes) -> list[Row]:
    return [("sua "[x // 3], x % 3) for x in data]


def segments(placed: DataFrame, schema: str) -> DataFrame:
    """One row for each part of a conversation: counts, and either the whole conversation's edits or the matrix of a piece."""
    def finish(out: dict, rows: list[Row], inner: bool) -> dict:
        if not inner:
            return out | {"whole": False, "rows": packed(rows), "costs": matrix(rows)}
        audit, state = walk(rows, END, 0)
        vector, total = backward(rows, END)
        return out | {"whole": True, "audit": audit + closing(state), "cost": total + vector[0]}

    fields = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for part, rows in groupby(dicts(batches), lambda r: r["part"]):
            held, first = None, True                       # a part's first and last segment may go on elsewhere
            for conv_id, found in groupby(rows, lambda r: r["conv_id"]):
                if held is not None:
                    made.append(finish(*held, inner=not first))
                    first = False
                held = segment(part, conv_id, found)
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, fields)
                    made = []
            made.append(finish(*held, inner=False))
        if made:
            yield pa.RecordBatch.from_pylist(made, fields)

    return by_part(placed).mapInArrow(run, schema)


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(f.split(" ")[0], _ARROW.get(f.split(" ")[1], pa.string())) for f in schema.split(", ")])


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string()), "smallint": pa.int16(), "tinyint": pa.int8()}


def streamed(rows: DataFrame, schema: str, make, *by: str) -> DataFrame:
    """``make(conv_id, rows)`` over the rows of each conversation, sorted by ``by``; it takes and gives dictionaries, one by one."""
    fields = arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for conv_id, found in groupby(dicts(batches), lambda r: r["conv_id"]):
            for out in make(conv_id, found):
                made.append(out)
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, fields)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, fields)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *by)]
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def connect(conv_id, found: Iterable[dict]) -> Iterator[dict]:
    """The costs at the end of each of a conversation's segments, and its counts and cost on the first."""
    pieces = list(found)                                   # at most one a partition
    costs, ends = END, []
    for p in reversed(pieces):
        ends.append(costs)
        costs = [min(p["costs"][4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
    whole = {c: sum(p[c] for p in pieces) for c in COUNTS}
    last = None
    for a, b in zip(pieces, pieces[1:], strict=False):
        whole["illegal"] += (a["last_role"], b["first_role"]) not in LEGAL
    for p in pieces:                                       # a turn that two segments share is counted once
        whole["turns"] -= last is not None and p["first_turn"] == last
        last = p["last_turn"] if p["last_turn"] is not None else last
    turns = [p[c] for p in pieces for c in ("first_turn", "last_turn") if p[c] is not None]
    whole |= {"cost": costs[0], "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}
    for i, (p, end) in enumerate(zip(pieces, reversed(ends), strict=True)):
        here = {"part": p["part"], "conv_id": conv_id, "at": i, "last": i == len(pieces) - 1, "ends": [x - min(end) for x in end]}
        yield here | (whole if i == 0 else {})


def string_together(conv_id, found: Iterable[dict]) -> Iterator[dict]:
    """The state in which each segment begins, and its edits from there."""
    state = 0
    for p in found:
        yield {"part": p["part"], "conv_id": conv_id, "state": state, "audit": p["audits"][state]}
        state = p["states"][state]


def split_conversations(pieces: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Counts of the conversations whose segments lie in several parts (or may), and the edits of their segments."""
    named = lambda s: s.format(**kinds)
    ends_schema = named("part int, conv_id {id}, at int, last boolean, ends array<bigint>, blank bigint, duplicate bigint, truncated bigint, "
                        "illegal bigint, turns bigint, cost bigint, first_turn {turn}, last_turn {turn}")
    ends = stage(streamed(pieces.drop("rows", "audit", "cost", "whole"), ends_schema, connect, "part"), "segment_ends")
    both = pieces.select("part", "conv_id", "rows").join(ends.select("part", F.col("conv_id").alias("of"), "at", "last", "ends"), "part")
    both = both.where(F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, end = unpacked(r["rows"]), tuple(r["ends"])
                done = [walk(rows, end, s) for s in range(4 if r["at"] else 1)]
                audits = [a + closing(s) if r["last"] else a for a, s in done]
                made = {"part": r["part"], "conv_id": r["conv_id"], "audits": audits, "states": [s for _, s in done]}
                yield pa.RecordBatch.from_pylist([made], fields)

    schema = named("part int, conv_id {id}, audits array<string>, states array<bigint>")
    fields = arrow(schema)
    walked = stage(both.mapInArrow(walks, schema), "segment_walks")
    chosen = streamed(walked, named("part int, conv_id {id}, state int, audit string"), string_together, "part")
    return ends.where("at = 0"), stage(chosen, "segment_edits")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows (conv_id, turn, role, text): one line for each conversation (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit), and the rows after repair (conv_id, part, at, edit, role, text), which follow each other in the order of part, at."""
    kinds = {"id": rows.schema["conv_id"].dataType.simpleString(), "turn": rows.schema["turn"].dataType.simpleString()}
    distinct, placed = ordered(rows)
    found = stage(segments(placed, SEGMENT.format(**kinds)), "segments")
    counts, pieces = split_conversations(found.where("NOT whole"), kinds)
    inner = found.where("whole")
    pieces = inner.select("part", "conv_id", F.lit(0).alias("state"), "audit").unionByName(pieces)
    columns = ("conv_id", "blank", "duplicate", "truncated", "illegal", "turns", "cost", "first_turn", "last_turn")
    counts = inner.select(*columns).unionByName(counts.select(*columns))
    span = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    counts = counts.select("conv_id", span.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("pieces"))
    whole = whole.select(F.col("conv_id").alias("of"), F.array_join("pieces.audit", "").alias("audit"))
    lines = counts.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return lines, repaired_rows(distinct, placed, pieces, kinds)


def repaired_rows(distinct: DataFrame, placed: DataFrame, pieces: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The rows that stay, and those inserted, in order (part, at)."""
    schema = "part int, conv_id {id}, at bigint, edit string, role string, turn {turn}, old string, same string".format(**kinds)
    fields = arrow(schema)
    none = lambda *names: [F.lit(None).cast(placed.schema[n].dataType).alias(n) for n in names]
    both = placed.select("part", "conv_id", F.lit(1).alias("tag"), "turn", "role", "same", "n", F.lit(None).cast("int").alias("state"),
                         F.lit(None).cast("string").alias("audit"))
    both = both.unionByName(pieces.select("part", "conv_id", F.lit(0).alias("tag"), *none("turn", "role", "same", "n"), "state", "audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for (part, conv_id), found in groupby(dicts(batches), lambda r: (r["part"], r["conv_id"])):
            piece = next(found)
            state, at, place = piece["state"], 0, 0        # place: in the string of edits
            audit = piece["audit"]
            line = lambda edit, role, **row: {"part": part, "conv_id": conv_id, "at": at, "edit": edit, "role": role, **row}  # noqa: E731, B023
            for r in found:
                for _ in range(r["n"]):
                    while audit[place] == "I":
                        state = NEXT[state]
                        made.append(line("I", TURN[state]))
                        place, at = place + 1, at + 1
                    edit, place = audit[place], place + 1
                    if edit == "D":
                        continue
                    state = KEPT[r["role"][:1]][state] if edit == "K" else NEXT[state]
                    made.append(line(edit, r["role"] if edit == "K" else TURN[state], turn=r["turn"], old=r["role"], same=r["same"]))
                    at += 1
                if len(made) >= 1000:
                    yield pa.RecordBatch.from_pylist(made, fields)
                    made = []
            while place < len(audit):
                state = NEXT[state]
                made.append(line("I", TURN[state]))
                place, at = place + 1, at + 1
        if made:
            yield pa.RecordBatch.from_pylist(made, fields)

    staying = stage(by_part(both, "tag").mapInArrow(run, schema), "staying_turns")
    texts = distinct.select(F.col("conv_id").alias("of"), F.col("turn").alias("in"), F.col("role").alias("by"), F.col("same").alias("alike"), "text")
    met = (F.col("same") == F.col("alike")) & F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("in")) & (F.col("old") == F.col("by"))
    kept = staying.where("edit <> 'I'").join(texts, met).select("conv_id", "part", "at", "edit", "role", "text")
    added = staying.where("edit = 'I'").select("conv_id", "part", "at", "edit", "role", F.lit("").alias("text"))
    return kept.unionByName(added)


def digests(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of each conversation's ``role:text`` lines, for all conversations of ``rows``.

    The digest of one text cannot be computed in parts: a conversation's lines pass through one task, one after the other,
    and are not held."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def one(conv_id, found: Iterable[dict]) -> Iterator[dict]:
        digest = hashlib.sha256()
        for i, r in enumerate(x for x in found if x["line"] is not None):
            digest.update(("\n" if i else "").encode() + r["line"].encode("utf-8", "surrogatepass"))
        yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}

    none = F.lit(None)
    every = rows.select("conv_id").distinct().select("conv_id", none.cast("int").alias("part"), none.cast("bigint").alias("at"), none.cast("string").alias("line"))
    lines = repaired.select("conv_id", "part", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    return streamed(every.unionByName(lines), f"conv_id {kind}, repaired_sha256 string", one, "part", "at")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults that depend on crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 makes its role user. A null counts as one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(case == 4, "user").otherwise(known("role"))
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("case")).where("case <> 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1)))).drop("case", "copy"))


def audit_table(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` after damage: its faults, the cost and initials of its repair, and the repaired text's digest."""
    lines, repaired = repair(damaged(rows))
    lines = stage(lines, "conversation_lines").withColumnRenamed("conv_id", "of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = digests(rows, repaired).join(lines, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), "repaired_sha256")


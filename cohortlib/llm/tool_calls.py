"""Tool-call linking: calls and their results brought together, ordered, checked and written as canonical JSON.

Calls and results are joined by (conversation, identifier). Calls of a conversation are ordered by their dependencies:
a call's level is the length of the longest chain of calls it waits for, and its position counts the calls of its
conversation by level, then turn, then identifier. Arguments are checked against the schema of the tool. Each link
becomes one JSON object with sorted keys, no blanks and no needless escapes.

Conversations with up to ``LARGE`` calls are ordered each in one task; larger ones in blocks of ``BLOCK`` calls, which
hand on levels to each other in rounds. Both give the same levels. Calls that wait for each other in a circle, or for such calls,
have neither level nor position. Dependencies on calls that the conversation does not have are ignored.

An identifier used again counts in n_calls or n_results, and the smallest call (by turn, name, arguments) or
result stands for all, so repeated rows never multiply. Results without a call stay, without name, level and verdict.
Rows without a conversation or identifier cannot be linked and are left out.

Arguments are JSON as RFC 8259 has it: NaN, infinities and numbers beyond a double are "arguments are not JSON", and so is
what nests deeper than ``DEPTH``; such arguments are written as the text they came as. A lone surrogate, which UTF-8 cannot hold, is
written as its escape.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import running_totals, runs, stage

LARGE = 10_000
BLOCK = 100_000                                            # calls of large conversations that one task orders
DEPTH = 200                                                # levels of arrays and objects in arguments
_MOST_FRAMES = 16
#: Tools of plain conversations: the fields of their arguments and what each must be.
SCHEMAS = {
    "ask": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 1500},
            "turn": {"type": "integer", "required": True, "minimum": 0}},
    "configure": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 500},
                  "turn": {"type": "integer", "required": True, "minimum": 0}},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[][{}]', re.DOTALL)
_LONE = re.compile("[\ud800-\udfff]")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("beyond a double")
    return value


def _refused(name: str):
    raise ValueError(f"{name} is not JSON")


def _depth(text: str) -> int:
    """How deep arrays and objects nest; brackets inside of strings do not count."""
    deepest = level = 0
    for found in _BRACKETS.finditer(text):
        level += {"[": 1, "{": 1, "]": -1, "}": -1}.get(found.group(), 0)
        deepest = max(deepest, level)
    return deepest


def parsed(text: str):
    """The value of a JSON text; ValueError for all that is not JSON or cannot be written as such again."""
    if text.count("[") + text.count("{") > DEPTH and _depth(text) > DEPTH:
        raise ValueError("nested too deep")
    return json.loads(text, parse_float=_finite, parse_int=_whole, parse_constant=_refused)


def _whole(text: str) -> int:
    """Whole numbers within the range of a double, exact."""
    _finite(text)
    return int(text)


def canonical(value) -> str:
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", out)


def first_error(name: str | None, arguments: str | None, schemas: dict) -> tuple[str | None, object]:
    """What is wrong with a call first (tool, JSON, then fields in the order of their names), and the parsed arguments."""
    try:
        value = parsed(arguments) if arguments is not None else None
    except ValueError:
        return "arguments are not JSON", arguments
    if name not in schemas:
        return "unknown tool", value
    if not isinstance(value, dict):
        return "arguments are not an object", value
    schema = schemas[name]
    for field in sorted(schema.keys() | value.keys()):
        rule = schema.get(field)
        if rule is None:
            return f"{field}: unknown field", value
        if field not in value:
            if rule.get("required"):
                return f"{field}: missing", value
            continue
        v = value[field]
        if not isinstance(v, _TYPES[rule["type"]]) or isinstance(v, bool) and rule["type"] != "boolean":
            return f"{field}: not a {rule['type']}", value
        if isinstance(v, str) and len(v) < rule.get("min_length", 0):
            return f"{field}: too short", value
        if isinstance(v, str) and len(v) > rule.get("max_length", len(v)):
            return f"{field}: too long", value
        if "minimum" in rule and v < rule["minimum"]:
            return f"{field}: too small", value
        if "one_of" in rule and v not in rule["one_of"]:
            return f"{field}: not allowed", value
    return None, value


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user or system turn is a call of ``ask`` or ``configure``, and an assistant turn the result of the call in the
    turn before. A call waits for the calls one and two turns before it."""
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure")
    call_id = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def before(back: int):
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))

    known = messages.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    calls = known.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", call_id.alias("call_id"), name.alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.array(before(1), before(2)).alias("after"))
    results = known.where("role = 'assistant'").select("conv_id", before(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def order_in_tasks(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, position; each conversation in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turn, ids, after in runs(batches, 1):
            place = {c: i for i, c in enumerate(ids)}
            waits = [[place[a] for a in set(x) if a in place] if x is not None else [] for x in after]
            missing = [len(w) for w in waits]
            next_of = defaultdict(list)
            for i, w in enumerate(waits):
                for p in w:
                    next_of[p].append(i)
            level = [-1] * len(ids)
            ready, depth = [i for i, m in enumerate(missing) if not m], 0
            while ready:
                following = []
                for i in ready:
                    level[i] = depth
                    for j in next_of[i]:
                        missing[j] -= 1
                        if not missing[j]:
                            following.append(j)
                ready, depth = following, depth + 1
            done = sorted((i for i in range(len(ids)) if level[i] >= 0), key=lambda i: (level[i], turn[i], ids[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[done]), pa.array(ids[done], pa.string()), pa.array([level[i] for i in done], pa.int32()),
                 pa.array(np.arange(len(done)), pa.int64())], ["conv_id", "call_id", "level", "position"])

    kind = calls.schema["conv_id"].dataType.simpleString()
    return (calls.select("conv_id", "turn", "call_id", "after").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "call_id")
            .mapInArrow(run, f"conv_id {kind}, call_id string, level int, position bigint"))


def _levels(blocks: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, level of the calls (block, conv_id, turn, call_id, inner, n_open, floor) that wait, by way of
    their block, for no open one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, conv, turn, ids, inner, n_open, floor in runs(batches, 1):
            place = {k: i for i, k in enumerate(zip(conv, ids, strict=True))}
            missing, next_of = n_open.tolist(), defaultdict(list)
            for i, w in enumerate(inner):
                for x in w if w is not None else ():
                    missing[i] += 1
                    next_of[place[conv[i], x]].append(i)
            level, ready, done = floor.tolist(), [i for i, m in enumerate(missing) if not m], []
            while ready:
                done.append(i := ready.pop())
                for j in next_of[i]:
                    level[j] = max(level[j], level[i] + 1)
                    missing[j] -= 1
                    if not missing[j]:
                        ready.append(j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[done]), pa.array(turn[done]), pa.array(ids[done], pa.string()), pa.array([level[i] for i in done], pa.int32())],
                ["conv_id", "turn", "call_id", "level"])

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return (blocks.select("block", "conv_id", "turn", "call_id", "inner", "n_open", "floor").repartition("block").sortWithinPartitions("block")
            .mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, call_id string, level int"))


def order_in_rounds(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same for conversations of any size, cut by turn into blocks of ``block`` calls.

    A round finds the levels inside the blocks, each in one task, and carries them over to the calls of other blocks that
    wait for them; blocks that got a level are done again in the next round. A chain takes a round for each time it
    enters another block, not for each call."""
    key = [F.col(c) for c in ("conv_id", "turn", "call_id")]
    own = calls.select("conv_id", "turn", "call_id").distinct().withColumn("one", F.lit(1))
    placed = running_totals(own, key, {"at": "one"}).select(
        "conv_id", "turn", "call_id", F.floor(F.col("at") / block).cast("long").alias("block"))
    placed = stage(placed, "blocks")
    asked = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("waits_for"))
    there = placed.select("conv_id", F.col("call_id").alias("waits_for"), F.col("block").alias("of_block"))
    edges = stage(asked.join(there, ["conv_id", "waits_for"]).join(placed.select("conv_id", "call_id", "block"), ["conv_id", "call_id"]), "edges")
    inner = edges.where("block = of_block").groupBy("conv_id", "call_id").agg(F.collect_list("waits_for").alias("inner"))
    waiting = placed.join(inner, ["conv_id", "call_id"], "left").repartitionByRange("block", "turn").sortWithinPartitions("block")
    waiting = stage(waiting, "waiting")
    outer = stage(edges.where("block <> of_block").select("conv_id", "call_id", "waits_for", "block", F.lit(None).cast("int").alias("level"),
                                                          F.lit(False).alias("new")), "outer")
    done, rows = [], waiting
    while True:
        open_ = outer.groupBy("conv_id", "call_id").agg(F.count_if(F.col("level").isNull()).alias("n_open"), F.max("level").alias("most"))
        ready = rows.join(open_, ["conv_id", "call_id"], "left").withColumns(
            {"n_open": F.coalesce("n_open", F.lit(0)), "floor": F.coalesce(F.col("most") + 1, F.lit(0))})
        done.append(stage(_levels(ready), "levels"))
        known = done[-1].select("conv_id", F.col("call_id").alias("waits_for"), F.col("level").alias("found")).distinct()
        both = outer.drop("new").join(known, ["conv_id", "waits_for"], "left")
        outer = stage(both.select("conv_id", "call_id", "waits_for", "block", F.coalesce("level", "found").alias("level"),
                                  (F.col("level").isNull() & F.col("found").isNotNull()).alias("new")), "outer")
        if len(done) == _MOST_FRAMES:
            done = [stage(_union(done).distinct(), "all_levels")]
        touched = [r.block for r in outer.where("new").select("block").distinct().collect()]      # one number for ``block`` calls
        if not touched:
            break
        rows = waiting.where(F.col("block").isin(touched))
    found = stage(_union(done).distinct(), "all_levels")                # a block may have been done more than once
    placed = running_totals(found.withColumn("one", F.lit(1)), [F.col(c) for c in ("conv_id", "level", "turn", "call_id")], {"rank": "one"})
    placed = stage(placed, "ranked")
    base = stage(placed.groupBy("conv_id").agg(F.min("rank").alias("base")), "bases")
    return placed.join(base, "conv_id").select("conv_id", "call_id", "level", (F.col("rank") - F.col("base")).alias("position"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def ordered(calls: DataFrame, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    big = stage(calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("conv_id"), "large")
    small = order_in_tasks(calls.join(big, "conv_id", "left_anti"))
    if big.isEmpty():
        return small
    return small.unionByName(order_in_rounds(stage(calls.join(big, "conv_id", "left_semi"), "large_calls"), block))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, large: int = LARGE) -> DataFrame:
    """conv_id, call_id, name, turn, level, position, n_calls, n_results, valid, error, json: one row per identifier."""
    best = F.min(F.struct("turn", "name", "arguments", "after")).alias("c")
    one = (calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
           .agg(best, F.count(F.lit(1)).alias("n_calls")))
    one = stage(one.select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    answers = (results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
               .agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results")))
    both = one.drop("after").join(answers, ["conv_id", "call_id"], "full").join(ordered(one, large), ["conv_id", "call_id"], "left")
    names = ["conv_id", "call_id", "name", "turn", "level", "position", "n_calls", "n_results"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "content", "n_calls", "n_results")), strict=True)
            out = []
            for call_id, name, arguments, content, n_calls, n_results in rows:
                whole = {"id": call_id}
                error = None
                if n_calls:
                    error, value = first_error(name, arguments, schemas)
                    whole |= {"name": name, "arguments": value}
                if n_results:
                    whole["result"] = content
                out.append((None if not n_calls else error is None, error and _LONE.sub("\ufffd", error), canonical(whole)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string()),
                 pa.array([o[2] for o in out], pa.string())], [*names, "valid", "error", "json"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_calls", "n_results")})
    return both.select(*names, "arguments", "content").mapInArrow(
        run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", valid boolean, error string, json string")

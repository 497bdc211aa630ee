"""Repair of conversations against a search over all edits, on small frames and on the test tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from cohortlib.llm import conversation_repair as cr
from cohortlib.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, roles and texts) of the cheapest edits of [(role, text, fault)], by trying all of them."""
    @lru_cache(None)
    def best(i, said):                                     # said: "" nothing, "s", "u", "a"
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[said]
        name = {"u": "user", "a": "assistant"}[due]
        ways = []
        if i == len(rows):
            if said in ("", "a"):
                return 0, "", ()
            c, e, out = best(i, due) if said == "u" else tuple_after_system()
            return 5 + c, "I" + e, ((name, ""), *out)
        for c, e, out, moved in tries(i, said, 0):
            ways.append((c, e, out))
        return min(ways, key=lambda w: w[:2])

    def tuple_after_system():
        return 5, "I", (("assistant", ""),)

    def tries(i, said, inserted):
        role, text, fault = rows[i]
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[said]
        name = {"u": "user", "a": "assistant"}[due]
        extra = 5 if fault == "truncated" else 0
        c, e, out = best(i + 1, said)
        yield 2 + c, "D" + e, out, said
        if fault not in ("blank", "duplicate"):
            c, e, out = best(i + 1, due)
            yield 1 + extra + c, "R" + e, ((name, text), *out), due
            first = role[:1]
            if first == due or (first == "s" and said == ""):
                c, e, out = best(i + 1, first)
                yield extra + c, "K" + e, ((role, text), *out), first
        if inserted < 3:
            for c, e, out, moved in tries(i, due, inserted + 1):
                yield 5 + c, "I" + e, ((name, ""), *out), moved

    return best(0, "")


def expected(rows):
    """Lines by conversation from (conv_id, turn, role, text), damage included."""
    space = lambda v: " " if v is None else v
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = of[conv]
        case = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
        role = "user" if case == 4 else role
        if case:
            same = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            kept += [((turn is not None, turn or 0, role, same), turn, role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, found in of.items():
        found = [x[1:] for x in sorted(found, key=lambda x: x[0])]
        seen, faulty = set(), []
        for _, role, text in found:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, *_ in found if t is not None}
        cost, audit, left = cheapest(tuple(faulty))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        number = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, number("blank"), number("duplicate"), number("truncated"), illegal,
                     cost, audit, digest)
    return out


def got(table):
    rows = table.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def run(spark, rows):
    return got(cr.audit_table(spark.createDataFrame(rows, SCHEMA)))


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]
TEXTS = ["Yes.", "No!", "so", "", " \t\n", None, "Why?  ", "a.b", "é.\n", "é"]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_random_conversations(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([None, *range(30)]), r.choice([None, *range(12)]), r.choice(ROLES), r.choice(TEXTS)) for _ in range(250)]
    rows += [r.choice(rows) for _ in range(30)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "system", "tool"]), f"{r.choice(TEXTS) or ''}{r.choice(['', t])}{r.choice('.!,')}") for t in range(600)]
    rows += [(7, 300, "user", "again.")] * 50 + [(8, 0, "user", "a.")]
    import sys
    sys.setrecursionlimit(20_000)
    assert run(spark, rows) == expected(rows)


def test_all_rows_dropped_and_empty(spark):
    drops = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert run(spark, [(*drops, "user", "a.")]) == {drops[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_ties_are_ascii_least():
    rows = [("u", 0), ("u", 0), ("a", 0)]
    assert cr.walk(rows, cr.END, 0)[0] == "DKK" and cr.walk([("u", 1)] * 3, cr.END, 0)[0] == "DDD"


def test_walk_with_checkpoints_is_the_search():
    r = random.Random(9)
    name = {0: "", 1: "truncated", 2: "blank"}
    for n in (*range(12), 60, 200):
        rows = [(r.choice("suat"), r.choice([0, 0, 0, 1, 2])) for _ in range(n)]
        cost, audit, _ = cheapest(tuple((i, str(k), name[f]) for k, (i, f) in enumerate(rows)))
        vector, total = cr.backward(rows, cr.END)
        done, state = cr.walk(rows, cr.END, 0)
        assert (total + vector[0], done + cr.closing(state)) == (cost, audit)
        cut = n // 3                                       # the same over two segments
        m = cr.matrix(rows[cut:])
        assert cr.backward(rows[:cut], cr.END)[0] is not None
        ends = [min(m[4 * s + t] + cr.END[t] for t in range(4)) for s in range(4)]
        one, s = cr.walk(rows[:cut], tuple(x - min(ends) for x in ends), 0)
        two, s = cr.walk(rows[cut:], cr.END, s)
        assert one + two + cr.closing(s) == audit


def test_repaired_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 1, "x"), (1, 1, "user", "Ho.", 2, "y"), (2, 0, "assistant", "x" * 500_000 + ".", 0, "")],
                               SCHEMA + ", part int, same string")
    lines, rows = cr.repair(df)
    assert sorted((r.conv_id, r.cost, r.audit) for r in lines.collect()) == [(1, 1, "KR"), (2, 2, "D")]
    assert [(r.edit, r.role, r.text) for r in rows.where("conv_id = 1").orderBy("part", "at").collect()] == [("K", "user", "Hi."), ("R", "assistant", "Ho.")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, DATA)) == expected(rows)

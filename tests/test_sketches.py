"""Distinct members from sketches, against exact counts."""

import pytest

from cohortlib.operators import utilization as ut

LINES = "BA_Category string, Measure_Name string, Measure_Period string, LOC string, Client_Master_BK string"


@pytest.fixture(scope="module")
def lines(spark):
    """40,000 members; each is in two neighbouring periods, and one member owns a third of all rows."""
    one = spark.range(80_000).selectExpr("'After' BA_Category", "'Use' Measure_Name", "concat('Year ', (id + id div 40000) % 4) Measure_Period",
                                         "if(id % 3 = 0, null, 'OP') LOC", "cast(id % 40000 as string) Client_Master_BK")
    hot = spark.range(40_000).selectExpr("'After'", "'Use'", "'Year 0'", "'IP'", "'7'")
    return one.unionAll(hot)


@pytest.mark.parametrize("by", [["BA_Category"], ["Measure_Period"], ["Measure_Period", "LOC"], ["LOC"]])
def test_unions_are_within_the_bound(lines, by):
    exact = {tuple(r[c] for c in by): (r.n, r.m) for r in lines.groupBy(*by).agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(
        lines.groupBy(*[c for c in by]).agg(ut.F.count_distinct("Client_Master_BK").alias("m")).select(*[ut.F.col(c).alias(f"r_{c}") for c in by], "m"),
        [ut.F.expr(f"{c} <=> r_{c}") for c in by]).collect()}
    got = {tuple(r[c] for c in by): (r.n_rows, r.n_members_estimated) for r in ut.estimated_members(ut.member_sketches(lines), by).collect()}
    assert got.keys() == exact.keys()
    for k, (n, m) in exact.items():
        assert got[k][0] == n and abs(got[k][1] - m) <= max(1, 4 * ut.SKETCH_ERROR * m)


def test_parts_united_are_the_whole(spark, lines, tmp_path):
    """Sketches of parts of the lines, written apart, give the estimate of all lines together, in any order."""
    parts = lines.randomSplit([0.2, 0.5, 0.3], 1)
    for i, part in enumerate(parts):
        ut.member_sketches(part).write.parquet(f"{tmp_path}/{i}")
    got = ut.estimated_members(spark.read.parquet(*(f"{tmp_path}/{i}" for i in (2, 0, 1))), ["BA_Category"]).first()
    assert got.n_rows == 120_000 and abs(got.n_members_estimated - 40_000) <= 4 * ut.SKETCH_ERROR * 40_000


def test_null_members_and_no_lines(spark):
    df = spark.createDataFrame([("After", "Use", None, None, None), ("After", "Use", None, None, "a"), ("After", "Use", None, "OP", "a")], LINES)
    got = ut.estimated_members(ut.member_sketches(df), ["BA_Category"]).collect()
    assert [(r.n_rows, r.n_members_estimated) for r in got] == [(3, 1)]
    assert ut.estimated_members(ut.member_sketches(df.limit(0)), ["LOC"]).count() == 0


def test_a_question_reads_sketches_only(spark, lines, tmp_path):
    path = f"{tmp_path}/sketches"
    ut.member_sketches(lines).write.parquet(path)
    plan = ut.estimated_members(spark.read.parquet(path), ["LOC"])._jdf.queryExecution().executedPlan().toString()
    assert "Client_Master_BK" not in plan and plan.count("Exchange") == 1

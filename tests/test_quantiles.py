"""Refined quantiles against the built-in percentile and numpy, and the plan of stacked frequency tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlib import CHILD
from cohortlib.operators import describe
from cohortlib.operators.quantiles import quantiles

P = (0.0, 0.25, 0.5, 0.75, 1.0)


def counted(df):
    return df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))


@pytest.mark.parametrize("bins,levels", [(1024, 2), (2, 3), (3, 1), (16, 0)])
def test_against_percentile(spark, bins, levels):
    r = random.Random(bins)
    rows = [(None, 5.0)] + [("one", -2.5)] + [("same", 7.0)] * 9
    rows += [("ints", float(r.randint(0, 20))) for _ in range(200)] + [("wide", r.choice([-1, 1]) * 10.0 ** r.uniform(-200, 200)) for _ in range(300)]
    rows += [("edge", v) for v in (0.1, 0.2, 0.3, 0.1 + 0.2, 1e-300, -1e-300, 1.7e308, -1.7e308)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.n, x.q) for x in quantiles(counted(df), ["g"], P, bins, levels).collect()}
    want = {x.g: (x.n, x.q) for x in df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*map(F.lit, P))).alias("q")).collect()}
    assert got == want


def test_many_distinct_values_stay_out_of_one_buffer(spark):
    """Of a group with 10^6 values at most a few thousand reach the rank that is counted through."""
    df = spark.range(1_000_000).select(F.lit("all").alias("g"), (F.randn(7) * 3 + F.col("id") * 1e-9).alias("v"))
    freq = counted(df)
    got = quantiles(freq, ["g"], (0.25, 0.5, 0.75)).first().q
    want = np.quantile([x.v for x in df.select("v").toLocalIterator()], [0.25, 0.5, 0.75])
    assert got == pytest.approx(list(want), abs=1e-12)
    plan = quantiles(freq, ["g"], (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_empty_and_several_keys(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles(counted(df), ["g"], P).count() == 0
    two = spark.createDataFrame([("a", None, 1, 2), ("a", None, 3, 2), ("a", 1, 9, 1)], "g string, h int, v int, k int")
    assert sorted((x.g, str(x.h), x.n, x.q) for x in quantiles(two, ["g", "h"], (0.5,)).collect()) == [("a", "1", 1, [9.0]), ("a", "None", 4, [2.0])]


def test_box_stats_use_no_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 4.0)], "g string, v double")
    plan = describe.box_stats(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_stacked_tables_are_one_expand_and_one_exchange_of_counts(spark):
    cols = ["Gender_Label", "AgeCat", "RaceCat", "MH_SA", "ASD_Measure_Year", "ID_Measure_Year"]
    df = spark.createDataFrame([("Male", None, "White", "MH", "Y", None), (None, None, "White", "SA", "N", "N"), ("Male", "11 to 13", None, "MH", None, "Y")],
                               ", ".join(f"{c} string" for c in cols))
    out = describe.demographics_table(df, CHILD)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Expand" in x or "Exchange hashpartitioning" in x]
    assert sum("Expand" in x for x in lines) == 1 and len(lines) == 3           # counts, then the few counts by section
    rows = out.collect()
    assert sorted({r.section for r in rows}) == sorted({"Gender", "Age at Admission", "Race", "Does member have SA hx", "ASD diagnosis", "ID diagnosis",
                                                         "Does member have ASD and/or ID diagnosis"})
    for section in {r.section for r in rows}:
        assert sum(r.n for r in rows if r.section == section) == 3
    assert {(r.Demos, r.n) for r in rows if r.section == "Gender"} == {("Male", 2), (None, 1)}

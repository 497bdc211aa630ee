import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlib import ADULT
from cohortlib.operators import describe, utilization


def one(spark, values, schema="v int"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_frequency_keeps_missing_and_sums_to_100(spark):
    df = one(spark, ["a"] * 3 + ["b"] * 3 + [None] * 2, "g string")
    got = describe.freq_pct(df, "g").orderBy("display_rank").collect()
    assert [(r["g"], r["n"]) for r in got] == [("a", 3), ("b", 3), (None, 2)]
    assert sum(r["percent"] for r in got) == pytest.approx(100)
    got = describe.freq_pct(df, "g", ["b", "a"]).orderBy("display_rank").collect()
    assert [r["g"] for r in got] == ["b", "a", None]
    assert describe.freq_table(df, "g").count() == 2
    assert {r["g"]: r["perc"] for r in describe.share_table(df, "g", 1).collect()} == {"a": 37.5, "b": 37.5, None: 25.0}


def test_summary_statistics(spark):
    r = describe.num_summary(one(spark, [1, 2, 4, 10, None]), "v", (), "X").first()
    assert (r["AvgX"], r["MedX"], r["IQRX"], r["minX"], r["maxX"]) == (4.25, 3.0, 3.75, 1, 10)
    assert r["SDX"] == pytest.approx(4.031128874149275)
    assert describe.num_summary(one(spark, [3, 3, 2, 2, 9]), "v").first()["Mode"] == 2


def test_box_statistics_against_numpy(spark):
    rnd = random.Random(1)
    data = [(g, rnd.choice([rnd.randint(0, 40), rnd.randint(0, 400)])) for g in ("a", "b", None) for _ in range(150)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v int")
    got = {r["g"]: r for r in describe.box_stats(df, "v", ["g"]).collect()}
    for g in ("a", "b", None):
        x = np.array([v for k, v in data if k == g and v is not None], dtype=float)
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        r = got[g]
        assert (r["n"], r["q1"], r["median"], r["q3"]) == (len(x), q1, med, q3)
        assert (r["lower_whisker"], r["upper_whisker"], r["n_outliers"]) == (inside.min(), inside.max(), len(x) - len(inside))
        assert r["notch_high"] - med == pytest.approx(1.58 * (q3 - q1) / math.sqrt(len(x)))
    assert describe.box_stats(df, "v").first()["n"] == 450


def test_histogram_bins(spark):
    df = one(spark, [-1, 0, 1, 7, 8, 14, 15, 500, None])
    got = [(r["bin"], r["n"]) for r in describe.histogram(df, "v", 0, 7, 3).orderBy("bin").collect()]
    assert got == [(0, 1), (1, 3), (2, 2), (3, 1), (4, 1)]
    ends = describe.histogram(df, "v", 0, 7, 3).where("bin in (0, 4)").orderBy("bin").collect()
    assert [(r["lo"], r["hi"]) for r in ends] == [(None, 0.0), (21.0, None)]


def test_box_by_loc_is_ordered_by_mean(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 9), ("c", "x", 2)], "LOC string, g string, v int")
    got = {(r["LOC"], r["g"]): (r["mean"], r["display_rank"]) for r in describe.box_by_loc(df, "v", ["g"]).collect()}
    assert got == {("b", "x"): (9.0, 1), ("a", "x"): (1.0, 2), ("a", "y"): (3.0, 2), ("c", "x"): (2.0, 3)}


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 4)], "g string, v int")
    got = {r["variable"]: r for r in describe.profile(df, ["g"], ["v"]).collect()}
    assert (got["g"]["n_missing"], got["g"]["n_unique"], got["g"]["top_counts"]) == (1, 2, "a: 2, b: 1")
    assert (got["v"]["n_missing"], got["v"]["p0"], got["v"]["p50"], got["v"]["p100"]) == (1, 1.0, 2.0, 4.0)
    assert got["g"]["mean"] is None


def test_readmit_timing(spark):
    df = spark.createDataFrame([("Yes", 7), ("Yes", 15), ("Yes", 31), ("Yes", 170), ("No", None)], "Flag_Readmit string, Days_to_Readmit int")
    got = {(r["Readmit_Cat"], r["Week_Cat"]): r["perc"] for r in describe.readmit_timing(df).collect()}
    assert got == {("Month 1", "Week 1"): .25, ("Month 1", "Week 2"): .25, ("Month 2", "Month"): .25, ("Month 6", "Month"): .25}


LONG = ("Client_Master_BK string, BA_Category string, Measure_Name string, Measure_Period string, LOC string, Day_Count bigint, "
        "SurvivalDays int, Flag_Readmit string, ServiceEnd date")


@pytest.fixture
def long(spark):
    def line(m, ba, measure, period, loc, days, surv=180):
        return (m, ba, measure, period, loc, days, surv, "No" if surv == 180 else "Yes", __import__("datetime").date(1999, 5, 1))
    return spark.createDataFrame([
        line("m1", "After", "After Service", "180 Days", "OP", None), line("m1", "After", "After Service", "180 Days", "OP", 1),
        line("m2", "After", "After Service", "180 Days", "OP", 2), line("m3", "After", "After Service", None, None, 0, 60),
        line("m4", "After", "After Service", "180 Days", "OP", 30, 60), line("m4", "After", "After Service", "180 Days", "OP", 30, 60),
        line("m1", "Before", "Eligibility", "Year 1", None, 300), line("m2", "Before", "Eligibility", "Year 1", None, 150),
        line("m2", "Before", "Eligibility", "Year 2", None, 365), line("m2", "Before", "IP Discharges", "Year 1", "IP", 2),
        line("m2", "Before", "IP Discharges", None, None, 0),
        line("m2", "Before", "Additional Service", "Year 1", "EAC", 9), line("m2", "Before", "Prior Service", "Year 1", "OP", 73),
    ], LONG)


def test_missing_day_count_spoils_only_its_member(long):
    denominator = F.lit(4)
    got = {(r["Measure_Name"], r["Measure_Period"], r["LOC"]): r for r in utilization.service_summary(long, denominator).collect()}
    r = got[("After Service", "180 Days", "OP")]
    assert (r["N_UsingService"], r["AvgDays"], r["MedDays"], r["Perc_UsingService"]) == (3, 31.0, 31.0, 75.0)


def test_after_reports(long):
    got = {r["LOC"]: r for r in utilization.after_use_by_loc(long, F.lit(4)).collect()}
    assert got["OP"]["AvgRateDays30"] == pytest.approx((2 / 180 * 30 + 30) / 2) and got["OP"]["display_rank"] == 1
    assert got[None]["N_UsingService"] == 1
    by_loc = utilization.after_days_by_loc(long, F.lit(4)).collect()
    assert [r["LOC"] for r in by_loc] == ["OP"]
    dist = utilization.after_distribution(long, ADULT).collect()
    assert {r["Client_Master_BK"]: r["Days"] for r in dist} == {"m1": None, "m2": 2, "m4": 60}
    assert {r["yearDC"] for r in dist} == {1999}


def test_before_reports(long):
    elig = {r["Measure_Period"]: r["Perc_UsingService"] for r in utilization.eligibility_at_least(long, F.lit(4), ADULT).collect()}
    assert elig == {"Year 1": 25.0, "Year 2": 25.0}
    bands = {(r["Measure_Period"], r["EligCat"]): r["share"] for r in utilization.eligibility_bands(long).collect()}
    assert bands == {("Year 1", "300+ days"): .5, ("Year 1", "100-199 Days"): .5, ("Year 2", "300+ days"): 1.0}
    assert tuple(utilization.ip_by_year(long, F.lit(4), ADULT).first()) == ("Year 1", 1, 25.0, 2.0)
    assert tuple(utilization.additional_services(long, F.lit(4), ADULT).first()) == ("Year 1", "EAC", 1, 25.0, 9.0)
    assert utilization.prior_use_by_loc(long, F.lit(4), ADULT).first()["AvgRateDays30"] == pytest.approx(6.0)


def test_scalar_denominator(long):
    total = long.agg(F.count_distinct("Client_Master_BK")).scalar()
    r = [r for r in utilization.after_use_by_loc(long, total).collect() if r["LOC"] == "OP"][0]
    assert r["Perc_UsingService"] == 75.0


def test_schema_listing_and_fanout(spark, rows):
    df = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 1)], "Client_Master_BK string, LOS int")
    assert rows(describe.schema_listing(df)) == [(1, "Client_Master_BK", "string"), (2, "LOS", "int")]
    assert rows(describe.attribute_fanout(df)) == [("m1", 2)]

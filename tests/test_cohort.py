import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlib import ADULT
from cohortlib.operators import cohort

D0 = date(1999, 6, 1)


def day(n):
    return D0 + timedelta(days=n)


AUTH = "auth long, member long, sb date, se date, code string"


@pytest.fixture
def auth(spark):
    return spark.createDataFrame([
        (1, 10, day(0), day(5), "1-URGENT"),        # index of member 10
        (2, 10, day(40), day(45), "2-HIGH"),        # readmission after 35 days
        (3, 10, day(60), day(61), "1-URGENT"),
        (4, 10, day(-100), day(-95), "1-URGENT"),   # earlier episode, discharge inside the period
        (5, 20, day(0), day(5), "1-URGENT"),
        (6, 20, day(186), day(190), "1-URGENT"),    # 181 days after discharge: too late
        (7, 30, date(1997, 3, 1), date(1997, 3, 5), "1-URGENT"),   # outside the period
        (8, 40, day(0), day(3), "3-MEDIUM"),        # other level of care
        (9, 50, day(0), day(5), "1-URGENT"),
        (10, 50, day(0), day(5), "2-HIGH"),         # same dates: lower number is the index
        (11, 50, day(5), day(9), "2-HIGH"),         # readmission on the day of discharge
    ], AUTH)


def test_index_is_first_discharge_in_period(auth):
    got = {r["member"]: (r["auth"], r["first_ever"]) for r in cohort.index_episodes(auth, ADULT).collect()}
    assert got == {10: (4, "Y"), 20: (5, "Y"), 50: (9, "Y")}


def test_earlier_episode_outside_period_ends_first_ever(spark):
    df = spark.createDataFrame([(1, 1, date(1997, 1, 1), date(1997, 1, 9), "2-HIGH"), (2, 1, day(0), day(1), "1-URGENT")], AUTH)
    r = cohort.index_episodes(df, ADULT).first()
    assert (r["auth"], r["first_ever"]) == (2, "N")


def test_readmission_and_window(auth):
    index = cohort.index_episodes(auth, ADULT)
    got = {r["member"]: r for r in cohort.episodes(index, auth, ADULT).collect()}
    assert got[10]["readmit_auth"] == 1 and got[10]["days_to_readmit"] == 95
    assert got[10]["after_e"] == day(0) and got[10]["n_adm"] == 3
    assert got[20]["readmit_auth"] is None and got[20]["after_e"] == day(185)
    assert got[50]["readmit_auth"] == 11 and got[50]["days_to_readmit"] == 0


def test_merge_spans_counts_each_day_once(spark):
    spans = spark.createDataFrame([(1, day(0), day(10)), (1, day(5), day(20)), (1, day(30), day(40)), (1, day(40), day(41)),
                                   (1, day(50), day(50))], "member long, b date, e date")
    got = sorted((r["b"], r["e"]) for r in cohort.merge_spans(spans, ("member",)).collect())
    assert got == [(day(0), day(20)), (day(30), day(41))]


def _random_spans(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        b = rnd.randint(-1200, 200)
        out.append((rnd.choice([1, 1, 1, 2, 3]), day(b), day(b + rnd.randint(0, 60)), "ABC"[i % 3], rnd.choice(["SMALL", "LARGE", "PROMO"])))
    return out


@pytest.fixture
def eps(spark):
    rows = [(m, day(m), day(m + 4), day(m + 4), day(m + 4 + 60 * m)) for m in (1, 2, 3)]
    return spark.createDataFrame(rows, "member long, sb date, se date, after_b date, after_e date")


def test_days_against_brute_force(spark, eps):
    data = _random_spans(400)
    spans = spark.createDataFrame(data, "member long, b date, e date, sub string, code string")
    dim = spark.createDataFrame([("SMALL", "adult", "Outpatient"), ("LARGE", "adult", "Rehab"), ("LARGE", "child", "X")],
                                "code string, age_group string, LOC string")
    loc = {"SMALL": "Outpatient", "LARGE": "Rehab"}
    windows = {r["member"]: {"after": (r["after_b"], r["after_e"]), **{
        f"y{y}": (r["sb"] - timedelta(days=365 * y), r["sb"] - timedelta(days=365 * (y - 1))) for y in (1, 2, 3)}}
        for r in eps.collect()}
    want, covered = {}, {}
    for m, b, e, sub, code in data:
        for name, (wb, we) in windows[m].items():
            days = {b + timedelta(days=i) for i in range((e - b).days)}
            inside = {d for d in days if wb <= d < we}
            key = (m, loc.get(code), sub, name)
            want[key] = want.get(key, 0) + len(inside)
            covered.setdefault((m, name), set()).update(inside)
    got = {}
    for r in cohort.service_days(eps, spans, dim, ADULT).collect():
        for name in ("after", "y1", "y2", "y3"):
            got[(r["member"], r["LOC"], r["sub"], name)] = r[name]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    merged = {(r["member"], n): r[n] for r in cohort.covered_days(eps, spans, ADULT).collect() for n in ("y1", "y2", "y3")}
    assert {k: v for k, v in merged.items() if v} == {k: len(v) for k, v in covered.items() if v and k[1] != "after"}
    assert max(merged.values()) <= 365


def test_prior_windows_touch(eps):
    got = cohort.prior_windows(eps, ADULT).where("member = 1").orderBy("w_b").collect()
    assert [r["Measure_Period"] for r in got] == ["Year 3", "Year 2", "Year 1"]
    assert got[0]["w_e"] == got[1]["w_b"] and got[2]["w_e"] == day(1)


def test_flags_at_admission(spark, eps):
    spans = spark.createDataFrame([(1, day(-600), day(0)), (1, day(-600), day(5)), (2, day(-10), day(2)), (3, day(3), day(4))],
                                  "member long, b date, e date")
    assert {r["member"]: r["active"] for r in cohort.active_on(spans, eps).collect()} == {1: 1, 2: 0, 3: 1}
    assert {r["member"]: r["lasted"] for r in cohort.lasted_months(spans, eps, 18).collect()} == {1: 1, 2: 0}


def test_open_stays_and_spans(spark):
    """A stay without discharge is a readmission and an admission; an open span counts up to the end of every window."""
    auth = spark.createDataFrame([(1, 1, day(0), day(4), "1-URGENT"), (2, 1, day(26), None, "2-HIGH"), (3, 2, day(0), None, "1-URGENT")], AUTH)
    index = cohort.index_episodes(auth, ADULT)
    got = cohort.episodes(index, auth, ADULT).collect()
    assert [(r["member"], r["readmit_auth"], r["days_to_readmit"], r["n_adm"]) for r in got] == [(1, 2, 22, 1)]
    one = cohort.episodes(index, auth, ADULT)
    spans = spark.createDataFrame([(1, day(-10), None), (1, day(-800), day(-790))], "member long, b date, e date")
    assert cohort.covered_days(one, spans, ADULT).select("y1", "y2", "y3").collect()[0] == (10, 0, 10)
    assert cohort.active_on(spans, one).first()["active"] == 1
    assert cohort.lasted_months(spark.createDataFrame([(1, day(-700), None)], "member long, b date, e date"), one, 18).first()["lasted"] == 1
    merged = sorted((r["b"], r["e"]) for r in cohort.merge_spans(spans, ("member",)).collect())
    assert merged == [(day(-800), day(-790)), (day(-10), None)]
    services = spans.selectExpr("*", "'a' as sub", "'SMALL' as code")
    dim = spark.createDataFrame([("SMALL", "adult", "Outpatient")], "code string, age_group string, LOC string")
    assert [(r["LOC"], r["after"], r["y1"], r["y3"]) for r in cohort.service_days(one, services, dim, ADULT).collect()] == [("Outpatient", 22, 10, 10)]


def test_member_with_half_of_the_rows(spark, eps, rows, tmp_path):
    """The adaptive skew join splits the rows of a large member; the result is that of the plain join."""
    facts = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 997 + 10).alias("member"),
                                        F.date_add(F.lit(D0), -(F.col("id") % 900).cast("int")).alias("b"), F.lit(D0).alias("e"),
                                        F.lit("x" * 40).alias("sub"), F.lit("SMALL").alias("code"))
    facts.write.parquet(f"{tmp_path}/facts")
    spark.range(1, 2000).selectExpr("id as member", "date'1998-06-01' sb", "date'1998-06-04' se", "date'1998-06-04' after_b",
                                    "date'1998-09-01' after_e").write.parquet(f"{tmp_path}/eps")
    dim = spark.createDataFrame([("SMALL", "adult", "Outpatient")], "code string, age_group string, LOC string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}

    def days():
        return cohort.service_days(spark.read.parquet(f"{tmp_path}/eps"), spark.read.parquet(f"{tmp_path}/facts"), dim, ADULT)
    plain = rows(days())
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        split = days()
        assert rows(split) == plain
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_spans_are_shuffled_once(spark, eps):
    spans = spark.range(500).select((F.col("id") % 3 + 1).alias("member"), F.date_add(F.lit(D0), -F.col("id").cast("int")).alias("b"),
                                    F.lit(D0).alias("e"), F.lit("A").alias("sub"), F.lit("SMALL").alias("code"))
    dim = spark.createDataFrame([("SMALL", "adult", "Outpatient")], "code string, age_group string, LOC string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cohort.service_days(eps, spans, dim, ADULT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # spans and index, each by member; the lookup of the level of care comes after the reduction
    assert sum("Exchange hashpartitioning(member" in line and "code" not in line.split("ENSURE")[0].split("hashpartitioning")[1] for line in plain_lines(plan)) == 2


def plain_lines(plan):
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_lookup_keeps_unmatched_rows(spark):
    facts = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    dim = spark.createDataFrame([("a", "adult", "A"), ("b", "child", "B")], "code string, age_group string, LOC string")
    out = cohort.loc_grouping(facts, dim, "adult")
    assert sorted((str(r["code"]), str(r["LOC"])) for r in out.collect()) == [("None", "None"), ("a", "A"), ("b", "None")]

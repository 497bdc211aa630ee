"""The one pass over all spans, its plan, the reduction of the fact table, and bucketed stages."""

import os
import re
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_cohort import _random_spans, day

from cohortlib import ADULT, CHILD
from cohortlib.operators import cohort
from cohortlib.plans import Study
from cohortlib.sources import CohortInputs, load_inputs

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DIM = [("SMALL", "adult", "Outpatient"), ("LARGE", "adult", "Rehab"), ("LARGE", "child", "X")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def eps(spark):
    rows = [(m, day(m), day(m + 4), day(m + 4), day(m + 4 + 60 * m)) for m in (1, 2, 3)]
    return spark.createDataFrame(rows, "member long, sb date, se date, after_b date, after_e date")


def relations(spark, seed=3, n=300):
    """One frame of spans for each kind; some are still open, some empty."""
    out = {}
    for i, kind in enumerate(cohort.KINDS):
        rows = [(m, b, None if j % 29 == 0 else e + timedelta(days=400 * (kind == "bhrs") * (j % 2)), sub, code)
                for j, (m, b, e, sub, code) in enumerate(_random_spans(n, seed + i))]
        out[kind] = spark.createDataFrame(rows, "member long, b date, e date, sub string, code string")
    out["additional"] = out["additional"].withColumnRenamed("code", "LOC")
    return out


def inputs_of(spark, r):
    return CohortInputs(auth=None, services=r["service"], eligibility=r["eligibility"], additional=r["additional"], dhs=r["dhs"], bhrs=r["bhrs"],
                        members=None, loc_dim=spark.createDataFrame(DIM, "code string, age_group string, LOC string"))


def test_one_pass_gives_what_each_kind_gives_alone(spark, eps):
    r = relations(spark)
    inputs = inputs_of(spark, r)
    days = cohort.span_days(eps, cohort.tagged_spans(inputs, date(1990, 1, 1), date(2002, 1, 1)), inputs.loc_dim, ADULT).collect()
    years = [f"y{y}" for y in ADULT.years]
    found = {k: {(x.member, x.LOC, x.sub): x for x in days if x.kind == k} for k in cohort.KINDS}
    services = cohort.service_days(eps, r["service"], inputs.loc_dim, ADULT).collect()
    assert {(x.member, x.LOC, x.sub): tuple(x[c] for c in ("after", *years)) for x in services} == {
        k: tuple(x[c] for c in ("after", *years)) for k, x in found["service"].items()}
    additional = cohort.overlap_days(r["additional"], eps, ADULT, ("LOC",)).collect()
    assert {(x.member, x.LOC): tuple(x[c] for c in years) for x in additional} == {k[:2]: tuple(x[c] for c in years) for k, x in found["additional"].items()}
    for kind in cohort.DAYS_ONCE:
        alone = {x.member: tuple(x[c] for c in years) for x in cohort.covered_days(eps, r[kind], ADULT).collect()}
        assert {k: v for k, v in alone.items() if any(v)} == {k[0]: tuple(x[c] for c in years) for k, x in found[kind].items() if any(x[c] for c in years)}
    flags = {x.member: (x.lasted, x.active) for x in cohort.admission_flags(eps, inputs).collect()}
    one = {m: (max((x.lasted for x in days if x.member == m), default=0), max((x.active for x in days if x.member == m), default=0)) for m in flags}
    assert one == flags


def test_days_once_against_a_calendar(spark, eps):
    r = relations(spark, seed=20, n=120)
    inputs = inputs_of(spark, r)
    days = cohort.span_days(eps, cohort.tagged_spans(inputs, date(1990, 1, 1), date(2002, 1, 1)), inputs.loc_dim, ADULT)
    want = {}
    for e in eps.collect():
        spans = r["eligibility"].where(F.col("member") == e.member).collect()
        for y in ADULT.years:
            low, high = e.sb - timedelta(days=365 * y), e.sb - timedelta(days=365 * (y - 1))
            want[e.member, y] = sum(any(s.b <= low + timedelta(days=i) < (s.e or date.max) for s in spans) for i in range((high - low).days))
    got = {(x.member, y): x[f"y{y}"] for x in days.where("kind = 'eligibility'").collect() for y in ADULT.years}
    assert got == want


def test_empty_relations(spark, eps):
    r = {k: v.limit(0) for k, v in relations(spark, n=3).items()}
    inputs = inputs_of(spark, r)
    assert cohort.span_days(eps, cohort.tagged_spans(inputs, *[date(2000, 1, 1)] * 2), inputs.loc_dim, ADULT).count() == 0


def test_spans_are_shuffled_once_by_member(spark, eps, no_broadcast):
    inputs = inputs_of(spark, relations(spark))
    days = cohort.span_days(eps, cohort.tagged_spans(inputs, date(1990, 1, 1), date(2002, 1, 1)), inputs.loc_dim, ADULT)
    exchanges = [line for line in plan_of(days).splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all(re.search(r"hashpartitioning\(member#\d+L, \d+\)", x) for x in exchanges)     # spans, episodes


def test_large_member_is_split(spark, rows, tmp_path):
    """A member with half of the spans: the adaptive skew join splits its rows, the result is that of the plain join."""
    spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 997 + 10).alias("member"), F.element_at(F.array(*map(F.lit, cohort.KINDS)), (F.col("id") % 5 + 1).cast("int")).alias("kind"),
        F.date_add(F.lit(day(0)), -(F.col("id") % 900).cast("int")).alias("b"), F.lit(day(0)).alias("e"), F.lit("SMALL").alias("code"), F.lit("x" * 40).alias("sub"),
    ).write.parquet(f"{tmp_path}/spans")
    spark.range(1, 2000).selectExpr("id as member", "date'1998-06-01' sb", "date'1998-06-04' se", "date'1998-06-04' after_b", "date'1998-09-01' after_e").write.parquet(f"{tmp_path}/eps")
    dim = spark.createDataFrame(DIM, "code string, age_group string, LOC string")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    days = lambda: cohort.span_days(spark.read.parquet(f"{tmp_path}/eps"), spark.read.parquet(f"{tmp_path}/spans"), dim, ADULT)
    plain = rows(days())
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        split = days()
        assert rows(split) == plain
        assert "skew=true" in plan_of(split)
    finally:
        for k in conf:
            spark.conf.unset(k)


@pytest.fixture(scope="module")
def st(spark):
    made = Study(spark, load_inputs(spark, DATA, ADULT), ADULT)
    yield made
    made.release()


@needs_data
def test_extract_has_few_exchanges(spark, st, no_broadcast):
    """From the staged index on: authorizations once, spans once, and the tables with one row per member."""
    history = [x for x in plan_of(cohort.episodes(st.index, st.inputs.auth, ADULT)).splitlines() if "Exchange hashpartitioning" in x]
    spans = cohort.span_days(st.episodes, cohort.tagged_spans(st.inputs, *st.bounds), st.inputs.loc_dim, ADULT)
    shuffled = [x for x in plan_of(spans).splitlines() if "Exchange hashpartitioning" in x]
    rest = [x for x in plan_of(cohort.to_extract(st.episodes, st.days, st.given.members, ADULT)).splitlines() if "Exchange hashpartitioning" in x]
    assert (len(history), len(shuffled), len(rest)) == (3, 1, 1)      # index twice beside authorizations; spans; attributes


@needs_data
def test_stages_by_member_need_no_exchange(spark, st, no_broadcast):
    from cohortlib.operators import cleaning, reshape
    assert "Exchange" not in plan_of(cleaning.member_table(st.long))
    assert "Exchange" not in plan_of(reshape.wide_members(st.long, st.members, ADULT))
    assert "Exchange" not in plan_of(cohort.measure_lines(st.episodes, st.days, ADULT))


@needs_data
def test_dates_and_keys_reach_the_scan_of_the_lines(spark, st):
    assert st.inputs
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    near = st.given.narrow(st.index, *st.bounds, lambda name, df: df if name == "services" else st.kept[name])
    scan = next(x for x in plan_of(near.services).splitlines() if "l_shipdate" in x and "FileScan" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = scan[scan.index("PushedFilters"):]
    for part in ("LessThan(l_shipdate,2001-06-29", "GreaterThanOrEqual(l_quantity,50.0)", "GreaterThanOrEqual(l_shipdate,", "GreaterThanOrEqual(l_orderkey,"):
        assert part in pushed
    history = plan_of(cohort.episode_history(st.index, st.inputs.auth, ADULT))
    assert "LessThanOrEqual(b,2001-06-29)" in history and "In(code, [1-URGENT,2-HIGH])" in history


@needs_data
def test_bloom_filter_reduces_the_lines_before_their_exchange(spark, st, no_broadcast):
    threshold = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, "0")
    try:
        near = st.given.narrow(st.index, *st.bounds, lambda name, df: df if name == "services" else st.kept[name])
        lines = plan_of(near.services).splitlines()
    finally:
        spark.conf.set(threshold, old)
    scan = next(i for i, x in enumerate(lines) if "l_shipdate" in x and "FileScan" in x)
    above = lines[:scan]
    filtered = max(i for i, x in enumerate(above) if "might_contain" in x)
    assert filtered > max(i for i, x in enumerate(above) if "Exchange hashpartitioning(l_orderkey" in x)


@needs_data
def test_services_are_those_of_index_members(spark, st):
    own = st.given.services.join(st.index.select("member"), "member", "left_semi")
    first, last = st.bounds
    near = own.where((F.col("b") < F.lit(last)) & (F.col("e").isNull() | (F.col("e") > F.lit(first))))
    assert near.exceptAll(st.inputs.services).count() == 0
    assert st.inputs.services.count() <= own.count() < st.given.services.count()


@needs_data
def test_twin_shares_only_the_same_cohort(spark, st):
    import dataclasses
    twin = Study(spark, load_inputs(spark, DATA, CHILD), CHILD, st)
    assert st.inputs and twin.inputs and twin.kept["services"] is st.kept["services"]
    other = dataclasses.replace(CHILD, follow_up_days=90)
    own = Study(spark, load_inputs(spark, DATA, other), other, st)
    assert own.inputs and own.kept["services"] is not st.kept["services"]
    own.release()


@needs_data
def test_partitions_grow_with_the_index_members(spark, st, rows, monkeypatch):
    """More index members make more partitions while tables are staged; the tables are the same, and so are the session's options afterwards."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    monkeypatch.setattr(sys.modules[Study.__module__], "MEMBERS_PER_PARTITION", 10)
    many = Study(spark, load_inputs(spark, DATA, ADULT), ADULT)
    try:
        n = many.index.count()
        assert many.partitions == -(-n // 10) > int(before["spark.sql.shuffle.partitions"])
        for name in ("episodes", "days", "members", "wide"):
            assert rows(getattr(many, name)) == rows(getattr(st, name))
        assert f"INTO {many.partitions} BUCKETS" in spark.sql(f"SHOW CREATE TABLE {many.tables[0]}").first()[0]
        assert {k: spark.conf.get(k, None) for k in before} == before
    finally:
        many.release()


def test_scans_of_a_staged_table_are_split_small(spark, tmp_path, monkeypatch):
    """While a table is staged, a task reads no more bytes of files than of an exchange, whatever the size of the files."""
    at, key = str(tmp_path / "auth"), "spark.sql.files.maxPartitionBytes"
    codes = sorted(ADULT.index_codes)
    (spark.range(4000).select(F.col("id").alias("auth"), F.col("id").alias("member"), F.lit(ADULT.period_begin).alias("sb"),
                              F.lit(ADULT.period_begin).alias("se"), F.lit(codes[0]).alias("code"))
     .repartition(8).write.parquet(at))
    before = spark.conf.get(key, None)
    monkeypatch.setattr(sys.modules[Study.__module__], "STAGE_TASK_BYTES", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    st = Study(spark, CohortInputs(*[spark.read.parquet(at)] * 8), ADULT)
    try:
        assert st.index.count() == 4000
        st._staged("copy", spark.read.parquet(at))
        size = max(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".parquet"))
        files = [f for f in os.listdir(f"{st.stage_dir}/copy") if f.endswith(".parquet")]
        assert size > 1024 and len(files) >= 8                   # one file of the copy for each share of the input
        assert spark.conf.get(key, None) == before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        st.release()

"""Every named query against its SQL counterpart on the smallest test tables.

The hazard models use the next larger tables: with too few events some of their estimates are infinite.
"""

import datetime
import os

import pytest

import __spark_entry__ as entry_points
from cohortlib.plans import oracle, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.environ.get("TEST_SF_DIR_MODELS", "/root/testdata/sf0.01")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = {"readmission_overview": registry.readmission_overview, **registry.all_queries()}
SQL = oracle.all_sql()


def connect(data):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return {d: connect(d) for d in (DATA, LARGER)}


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    data = LARGER if name.startswith(("cox_", "coefficient_")) else DATA
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    res = con[data].execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, got) == table(cols, res.fetchall())


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.count() == 2 and "percent_readmit" in df.columns


def test_names_match():
    assert set(SQL) == set(QUERIES)


def test_wide_rows_equal_member_rows(spark):
    from cohortlib import ADULT, CHILD
    from cohortlib.plans import study
    for spec in (ADULT, CHILD):
        st = study(spark, DATA, spec)
        assert st.wide.count() == st.members.count()
        long_days = st.long.where("LOC = 'TCM' AND Measure_Period = 'Year 2'").agg({"Day_Count": "sum"}).first()[0]
        assert st.wide.agg({"Yr2Prior_TCM": "sum"}).first()[0] == long_days


def test_other_follow_up_renames_everything(spark):
    import dataclasses
    from cohortlib import ADULT
    from cohortlib.plans.study import Study
    from cohortlib.sources import load_inputs
    spec = dataclasses.replace(ADULT, follow_up_days=90)
    st = Study(spark, load_inputs(spark, DATA, spec), spec)
    assert st.long.where("Measure_Period = '90 Days'").count() > 0 and st.long.where("Measure_Period = '180 Days'").count() == 0
    assert st.wide.agg({"SurvivalDays": "max"}).first()[0] == 90
    assert st.wide.agg({"After_OP": "sum"}).first()[0] == st.long.where("BA_Category = 'After' AND LOC = 'Outpatient'").agg({"Day_Count": "sum"}).first()[0]


def test_release_deletes_the_stages(spark):
    from cohortlib import ADULT
    from cohortlib.plans.study import Study
    from cohortlib.sources import load_inputs
    st = Study(spark, load_inputs(spark, DATA, ADULT), ADULT)
    assert st.episodes.count() > 0
    local = st.stage_dir.removeprefix("file:")
    assert os.path.isdir(local)
    st.release()
    assert not os.path.exists(local)


def test_study_from_a_delivered_file(spark, tmp_path):
    """A run that starts from the CSV extract ends in the same tables as one from the raw relations."""
    from cohortlib import CHILD
    from cohortlib.operators import cohort
    from cohortlib.plans import Study, short_report, study
    from cohortlib.sources import EXTRACT_SCHEMA, read_extract, write_stage
    raw = study(spark, DATA, CHILD)
    path = write_stage(cohort.as_delivered(raw.extract).select(*EXTRACT_SCHEMA.fieldNames()), str(tmp_path), "x", fmt="csv")
    st = Study.from_extract(spark, read_extract(spark, path), CHILD)
    cols = sorted(raw.wide.columns)
    assert sorted(map(str, st.wide.select(cols).collect())) == sorted(map(str, raw.wide.select(cols).collect()))
    tables = short_report(st)
    assert len(tables) == 8 and all(df.columns for _, df in tables)
    timing = dict(tables)["Weeks until readmission"]
    assert all(r["label"].endswith("%") for r in timing.collect())

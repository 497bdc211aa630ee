from cohortlib import ADULT, CHILD
from cohortlib.operators import reshape

LONG = "Client_Master_BK string, BA_Category string, Measure_Name string, Measure_Period string, LOC string, Day_Count bigint"


def test_names_follow_the_run():
    adult, child = reshape.wide_names(ADULT), reshape.wide_names(CHILD)
    assert len(adult) == 60 and len(child) == 44 + 4
    assert adult["After_After Service_180 Days_23-Hour Bed"] == "After_23HrBed"
    assert adult["Before_Prior Service_Year 2_Methadone"] == "Yr2Prior_MAT"
    assert adult["Before_IP Discharges_Year 3_IP"] == "N_AIPDC_3YrPrior"
    assert child["Before_DHS_Year 1_NA"] == "Yr1Prior_DHS"
    assert child["Before_Additional Service_Year 2_Stepping Stones"] == "Yr2Prior_SteppingStones"
    import dataclasses
    shorter = reshape.wide_names(dataclasses.replace(ADULT, follow_up_days=90))
    assert shorter["After_After Service_90 Days_ACT"] == "After_ACT"


def test_wide_members(spark):
    long = spark.createDataFrame([
        ("m1", "After", "After Service", "180 Days", "ACT", 3), ("m1", "After", "After Service", "180 Days", "ACT", 4),
        ("m1", "After", "After Service", None, None, 0), ("m1", "Before", "Eligibility", "Year 1", None, 200),
        ("m2", "After", "After Service", "180 Days", "ACT", None), ("m2", "After", "After Service", "180 Days", "ACT", 4),
    ], LONG)
    people = spark.createDataFrame([("m1", 5), ("m1", 6), ("m2", 7), ("m3", 8)], "Client_Master_BK string, LOS int")
    out = reshape.wide_members(long, people, ADULT)
    got = sorted((r["Client_Master_BK"], r["LOS"], r["After_ACT"], r["Yr1Prior_Elig"], r["After_IOP"]) for r in out.collect())
    assert got == [("m1", 5, 7, 200, None), ("m1", 6, 7, 200, None), ("m2", 7, None, None, None), ("m3", 8, None, None, None)]
    assert not [c for c in out.columns if c.endswith("NA")]


def test_pivot_total_equals_long_total(spark):
    long = spark.createDataFrame([(f"m{i % 7}", "Before", "Prior Service", f"Year {i % 3 + 1}", "TCM", i) for i in range(60)], LONG)
    wide = reshape.wide_days(long, ADULT)
    total = sum((r[f"Yr{y}Prior_TCM"] or 0) for r in wide.collect() for y in (1, 2, 3))
    assert total == sum(range(60)) and wide.count() == 7


def test_unite_and_unpivot(spark, rows):
    df = spark.createDataFrame([("m", "After", None)], "Client_Master_BK string, a string, b string")
    assert reshape.unite(df, "k", ["a", "b"]).first()["k"] == "After_NA"
    wide = spark.createDataFrame([("m", 1, None)], "Client_Master_BK string, Yr1Prior_Elig int, Yr2Prior_Elig int")
    assert rows(reshape.long_again(wide, ["Yr1Prior_Elig", "Yr2Prior_Elig"], "c", "v")) == [
        ("m", "Yr1Prior_Elig", 1), ("m", "Yr2Prior_Elig", None)]


def test_drop_matching(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Yr2x int, aEAC int, keep int, Yr1EACx int")
    assert reshape.drop_matching(df, ["Yr2"], ["EAC"]).columns == ["keep", "Yr1EACx"]
    assert reshape.drop_matching(df).columns == df.columns


def test_model_table_columns(spark):
    long = spark.createDataFrame([("m1", "After", "After Service", "180 Days", "Outpatient", 3)], LONG)
    people = spark.createDataFrame(
        [("m1", "a1", 12, "N", None, "(100-1) ACUTE HOSPITAL SERVICES", 11, "Yes", "r", None, 40),
         ("m2", "a2", 15, "Y", None, None, 3, "No", None, None, 180)],
        "Client_Master_BK string, AuthorizationNumber string, Age int, ASD_Measure_Year string, ID_Measure_Year string, "
        "LOC_Label string, LOS int, Flag_Readmit string, Readmit_Auth string, Readmit_SB date, SurvivalDays int")
    out = {r["Client_Master_BK"]: r for r in reshape.model_table(reshape.wide_members(long, people, CHILD), CHILD).collect()}
    a, b = out["m1"], out["m2"]
    assert (a["After_OP"], a["After_RTF"], a["Yr1Prior_DHS"], a["Yr1Prior_AnyAIP"]) == ("Yes", "No", "No", "No")
    assert (a["Age14up"], a["LOScat"], a["eligcat"], a["ASDID"], a["Voluntary"], a["Flag_Readmit"]) == (
        "Under 14", "11 - 20", "Less than 50%", None, "Voluntary", 1)
    assert (b["Age14up"], b["ASDID"], b["Voluntary"], b["Flag_Readmit"]) == ("14+", "ASD or ID", None, 0)
    assert not [c for c in a.asDict() if c.startswith(("Yr2", "Yr3", "N_AIP")) or c.endswith("HostHomes")]
    assert {c.name for c in CHILD.covariates if c.name.startswith(("After", "Yr1"))} <= set(a.asDict())


def test_found_keys_become_columns(spark, tmp_path):
    """A level of care that nobody declared keeps its days, in columns after the declared ones; empty lines get none."""
    long = spark.createDataFrame([
        ("m1", "After", "After Service", "180 Days", "New (1.2), x", 3), ("m1", "After", "After Service", "180 Days", "ACT", 2),
        ("m2", "Before", "Prior Service", "Year 1", "Art", None), ("m2", "Before", "Prior Service", None, None, 0)], LONG)
    found = reshape.found_wide_keys(long, ADULT)
    assert found == ["After_After Service_180 Days_New (1.2), x", "Before_Prior Service_Year 1_Art"]
    people = spark.createDataFrame([("m1", 5), ("m2", 7)], "Client_Master_BK string, LOS int")
    out = reshape.wide_members(long, people, ADULT, found)
    assert out.columns[61:63] == found
    out.write.parquet(f"{tmp_path}/wide")
    got = {r["Client_Master_BK"]: (r["After_ACT"], r[found[0]], r[found[1]]) for r in spark.read.parquet(f"{tmp_path}/wide").collect()}
    assert got == {"m1": (2, 3, None), "m2": (None, None, None)}


def test_too_many_found_keys_are_an_error(spark, monkeypatch):
    import pytest
    monkeypatch.setattr(reshape, "MOST_FOUND", 3)
    long = spark.createDataFrame([("m", "After", "After Service", "180 Days", f"x{i}", 1) for i in range(5)], LONG)
    with pytest.raises(ValueError, match="more than 3 keys"):
        reshape.found_wide_keys(long, ADULT)

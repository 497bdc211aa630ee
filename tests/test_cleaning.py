import re

import pytest
from pyspark.sql import functions as F

from cohortlib import ADULT, CHILD
from cohortlib.operators import cleaning
from cohortlib.sources import EXTRACT_SCHEMA, read_extract, read_stage, write_stage
from cohortlib.sources.extract import malformed_cells

LINE = {"AuthorizationNumber": "1", "Client_Master_BK": "m1", "ServiceBegin": "07/01/2013", "ServiceEnd": "7/9/2013",
        "Gender_Label": "Female", "RaceEthnic_Label": "WHITE", "Age": 30, "ASD_Measure_Year": "N", "ID_Measure_Year": "N",
        "LOC_Label": "(100-1) ACUTE HOSPITAL SERVICES", "FirstEpEver": "Y", "MH_SA": "MH", "BA_Category": "After",
        "Measure_Name": "After Service", "Measure_Period": "180 Days", "LOC": "ACT", "Day_Count": 3, "Readmit_Auth": "0",
        "Readmit_SB": "NA", "Days_to_Readmit": None, "Flag_BHRS_18plus_Mths_Before_Admission": 0, "Flag_Active_DHS_Status": 1,
        "Ep180": None, "Post_Discharge_RTF_Start": None, "Post_Discharge_Days_to_RTF": None, "Clinical_Category": None,
        "HasServ_Before_Readmit": None}


def extract(spark, *changes):
    rows = [{**LINE, **c} for c in changes]
    return spark.createDataFrame([tuple(r[f] for f in EXTRACT_SCHEMA.fieldNames()) for r in rows], EXTRACT_SCHEMA)


def test_types_and_sentinels(spark):
    df = cleaning.clean_extract(extract(spark, {}, {"Readmit_Auth": "77", "Readmit_SB": "08/02/2013", "Measure_Period": "NA",
                                                    "LOC": "NA", "Days_to_Readmit": 24, "ServiceBegin": "bad"}), CHILD)
    a, b = df.collect()
    assert str(a["ServiceBegin"]) == "2013-07-01" and str(a["ServiceEnd"]) == "2013-07-09"
    assert a["Readmit_Auth"] is None and a["Readmit_SB"] is None
    assert b["Readmit_Auth"] == "77" and str(b["Readmit_SB"]) == "2013-08-02"
    assert b["Measure_Period"] is None and b["LOC"] is None and b["ServiceBegin"] is None
    assert a["Flag_Active_DHS_Status"] == "Yes" and a["Flag_BHRS_18plus_Mths_Before_Admission"] == "No"


def test_starting_point(spark):
    df = cleaning.starting_point(cleaning.clean_extract(extract(
        spark, {}, {"Readmit_Auth": "5", "Days_to_Readmit": 12, "RaceEthnic_Label": "UNKNOWN", "Age": None},
        {"RaceEthnic_Label": None}), ADULT), ADULT)
    a, b, c = df.collect()
    assert (a["LOS"], a["Flag_Readmit"], a["RaceCat"], a["AgeCat"], a["AgeCat2"], a["SurvivalDays"]) == (
        8, "No", "White", "26 to 35", "18 to 30", 180)
    assert (b["Flag_Readmit"], b["RaceCat"], b["AgeCat"], b["SurvivalDays"]) == ("Yes", None, None, 12)
    assert c["RaceCat"] is None
    assert not set(ADULT.drop_on_entry) & set(df.columns)


@pytest.mark.parametrize("spec,kept", [(ADULT, [None, 2]), (CHILD, [None, 1, 2])])
def test_quality_filter(spark, spec, kept):
    df = spark.createDataFrame([(1, None), (0, None), (1, 0), (1, 1), (1, 2), (None, 2)], "LOS int, Days_to_Readmit int")
    out = cleaning.quality_filter(df, spec.min_los, spec.min_readmit_days)
    assert sorted([r["Days_to_Readmit"] for r in out.collect()], key=str) == sorted(kept, key=str)


def test_exclusion_rules_with_every_column_missing(spark, rows):
    lines = [
        ("Before", "Prior Service", "Year 1", None), ("Before", "Prior Service", "Year 1", "ACT"),      # (a)
        ("Before", "Eligibility", None, None), ("Before", "Eligibility", "Year 1", None),               # (b)
        ("After", "After Service", "180 Days", None), ("After", "After Service", None, None),           # (c)
        ("After", "IP Admissions", None, "IP"), ("After", "IP Admissions", "180 Days", "IP"),           # (d)
        (None, "Prior Service", None, None), ("Before", None, "Year 1", None),                          # unknown: kept
        ("Before", "DHS", "Year 1", None),
        ("Before", "Additional Service", "Year 1", "(450-1) HOST HOMES - DHS CHILD"),
        ("Before", "Additional Service", "Year 1", None)]
    df = spark.createDataFrame(lines, "BA_Category string, Measure_Name string, Measure_Period string, LOC string")
    child = {lines[i] for i in (1, 3, 5, 7, 8, 9, 10, 11, 12)}
    assert set(map(tuple, cleaning.exclude(df, CHILD.rules).collect())) == child
    assert set(map(tuple, cleaning.exclude(df, ADULT.rules).collect())) == child - {lines[10], lines[11]}


def test_stage_audit_agrees_with_step_by_step(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i) for i in range(30)], "a int, b int")
    steps = [("known", F.col("b").isNotNull()), ("even", F.col("a") % 2 == 0)]
    got = cleaning.stage_audit(df, steps).orderBy("step_no").collect()
    assert [(r["rows_in"], r["rows_removed"], r["rows_out"]) for r in got] == [(30, 10, 20), (20, 10, 10)]


def test_observed_rows(spark):
    df, seen = cleaning.observe_rows(spark.range(12), "in")
    assert df.where("id < 5").count() == 5 and seen.get["rows"] == 12


def test_member_table_checks_and_levels(spark, rows):
    df = spark.createDataFrame([("m1", 1, "x", "After"), ("m1", 1, "y", "After"), ("m1", 2, "z", None)],
                               "Client_Master_BK string, LOS int, LOC string, BA_Category string")
    assert rows(cleaning.member_table(df, ["LOC", "BA_Category"])) == [("m1", 1), ("m1", 2)]
    q = spark.createDataFrame([(0, 0), (1, 3), (None, 0)], "Days_to_Readmit int, LOS int")
    assert tuple(cleaning.quality_checks(q, ADULT).first()) == (1, 2)
    assert tuple(cleaning.quality_checks(q, CHILD).first()) == (2, 2)
    assert rows(cleaning.level_list(df, ["BA_Category"])) == [("BA_Category", "After", 2), ("BA_Category", None, 1)]
    keyed = cleaning.as_category(df, "LOC", ["z", "y"])
    assert {r["LOC"]: r["LOC_key"] for r in keyed.collect()} == {"x": 3, "y": 2, "z": 1}


def test_csv_extract_and_stages(spark, tmp_path, rows):
    df = extract(spark, {}, {"LOC": "NA", "Measure_Period": "NA", "RaceEthnic_Label": None})
    path = write_stage(df.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("NA")).alias(f.name) for f in EXTRACT_SCHEMA]),
                       str(tmp_path), "extract", fmt="csv")
    back = read_extract(spark, path)
    assert {r["n"] for r in malformed_cells(spark, path).collect()} == {0}
    assert back.schema == EXTRACT_SCHEMA
    assert rows(back.select("LOC", "Measure_Period", "RaceEthnic_Label", "Day_Count")) == [
        ("ACT", "180 Days", "WHITE", 3), (None, None, None, 3)]
    write_stage(df, str(tmp_path), "stage", partition_by=("BA_Category",))
    assert rows(read_stage(spark, str(tmp_path), "stage").select(*df.columns)) == rows(df)
    write_stage(df, str(tmp_path), "text", fmt="csv")
    assert read_stage(spark, str(tmp_path), "text", fmt="csv").where("RaceEthnic_Label IS NULL").count() == 1


def test_extract_columns_are_found_by_name(spark, tmp_path):
    """The file may have its columns in another order; an absent one is named, and cells that do not fit are counted."""
    names = [f.name for f in EXTRACT_SCHEMA]
    line = {n: "NA" for n in names} | {"AuthorizationNumber": "7", "Client_Master_BK": "9", "Age": "x1", "Day_Count": "4"}
    turned = names[::-1] + ["More"]
    (tmp_path / "turned.csv").write_text(",".join(turned) + "\n" + ",".join(line.get(n, "?") for n in turned) + "\n")
    r = read_extract(spark, str(tmp_path / "turned.csv")).first()
    assert (r["AuthorizationNumber"], r["Client_Master_BK"], r["Age"], r["Day_Count"], r["LOC"]) == ("7", "9", None, 4, None)
    assert {r["column"]: r["n"] for r in malformed_cells(spark, str(tmp_path / "turned.csv")).collect() if r["n"]} == {"Age": 1}
    (tmp_path / "short.csv").write_text("Client_Master_BK,LOC\n1,a\n")
    with pytest.raises(ValueError, match="AuthorizationNumber"):
        read_extract(spark, str(tmp_path / "short.csv"))


def write_csv(path, text, name):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_guessed_types(spark, tmp_path):
    """Every cell counts, whichever file it is in; the counts say what made a type wider."""
    from cohortlib.sources import guess_types, read_extract
    write_csv(tmp_path / "f", "flag,id,big,x,day,code,none,late\nTRUE,1,3000000000,1.5,4/30/1999,01a,NA,1\nF,NA,1,2,12/01/2000,2,,2\n", "part-0.csv")
    write_csv(tmp_path / "f", "flag,id,big,x,day,code,none,late\nfalse,-7,2,1e3,1/1/2001,NA,NA,Y\n", "part-1.csv")
    path = str(tmp_path / "f")
    got = {r["column"]: r for r in guess_types(spark.read.csv(path, header=True, nullValue="NA")).collect()}
    assert {c: r["type"] for c, r in got.items()} == {"flag": "boolean", "id": "int", "big": "bigint", "x": "double", "day": "date", "code": "string",
                                                      "none": "string", "late": "string"}
    assert (got["id"].n, got["id"].n_missing, got["none"].n) == (2, 1, 0)
    assert (got["late"].unfit["int"], got["big"].unfit["int"], got["x"].unfit["bigint"], got["code"].unfit["int"]) == (1, 1, 2, 1)
    df = read_extract(spark, path, None)
    assert dict(df.dtypes) == {c: r["type"] for c, r in got.items()}
    assert sorted((str(r.flag), str(r.id), str(r.day)) for r in df.collect()) == [("False", "-7", "2001-01-01"), ("False", "None", "2000-12-01"), ("True", "1", "1999-04-30")]


def test_a_text_is_tried_once(spark):
    """Equal cells are counted before their text is tried, and each text fits what a cast of it does."""
    from cohortlib.sources import guess_types
    odd = ["1", " 7 ", "+3", "-0", "1.", ".5", "1e3", "1e", "0x1p3", "0x1", "1f", "2D", "3L", "inf", "-Infinity", "NaN", " nan ", "+inf", "infinit", "1/2/2020", "13/1/2020",
           "1/2/20", "01/02/1998", "2020-01-02", "1 2", "", " ", ".", "-", "Female", "T", "true", "9999999999", "99999999999999999999", "1_0", "\t4\n", None]
    df = spark.createDataFrame([(x,) for x in odd * 3], "a string")
    plan = guess_types(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[i#\d+, cell#\d+\]", plan)
    for text in odd[:-1]:
        cell, one = F.lit(text), guess_types(spark.createDataFrame([(text,)] * 2, "a string")).first()
        fits = {k: cell.try_cast(k).isNotNull() for k in ("int", "bigint", "double")} | {"date": F.try_to_date(cell, "M/d/yyyy").isNotNull()}
        want = spark.range(1).select(*(F.when(c, 0).otherwise(2).alias(k) for k, c in fits.items())).first().asDict()
        assert {k: v for k, v in one["unfit"].asDict().items() if k in want} == want and (one["n"], one["n_missing"]) == (2, 0), text
    got = guess_types(df).first()
    assert (got["type"], got["n"], got["n_missing"]) == ("string", 3 * (len(odd) - 1), 3)


def test_guessed_types_of_an_empty_file(spark, tmp_path):
    from cohortlib.sources import read_extract
    write_csv(tmp_path / "f", "a,b.c\n", "part-0.csv")
    df = read_extract(spark, str(tmp_path / "f"), None)
    assert df.dtypes == [("a", "string"), ("b.c", "string")] and df.count() == 0


def test_cleaned_extract_is_the_same_with_guessed_types(spark, tmp_path):
    """The delivered file read with its schema and with guessed types ends in the same clean table."""
    from cohortlib import CHILD
    from cohortlib.sources import EXTRACT_SCHEMA, read_extract
    names = EXTRACT_SCHEMA.fieldNames()
    values = {"AuthorizationNumber": "17", "Client_Master_BK": "4", "ServiceBegin": "04/30/1999", "ServiceEnd": "05/02/1999", "Age": "14", "Day_Count": "3",
              "Readmit_Auth": "0", "Readmit_SB": "NA", "Days_to_Readmit": "NA", "Flag_BHRS_18plus_Mths_Before_Admission": "1", "Flag_Active_DHS_Status": "0"}
    write_csv(tmp_path / "f", ",".join(names) + "\n" + "\n".join(",".join(values.get(n, "x") if i or n != "LOC" else "NA" for n in names) for i in range(3)) + "\n", "p.csv")
    clean = [cleaning.clean_extract(read_extract(spark, str(tmp_path / "f"), schema), CHILD) for schema in (EXTRACT_SCHEMA, None)]
    assert sorted(map(str, clean[0].collect())) == sorted(map(str, clean[1].select(clean[0].columns).collect()))


def test_order_of_appearance(spark, tmp_path):
    """Over several files, read in one task or in many; levels found nowhere come last."""
    rows = [("b", 1), ("a", 1), (None, 3), ("b", 2), ("c", 2), ("a", 9), ("d", 1)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y int").repartitionByRange(4, "i").sortWithinPartitions("i").drop("i").write.parquet(
        f"{tmp_path}/p")
    for most in ("128m", "1"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        df = spark.read.parquet(f"{tmp_path}/p")
        got = {(r.variable, r.level): r.level_no for r in cleaning.by_appearance(df, ["x", "y"]).collect()}
        assert got == {("x", "b"): 1, ("x", "a"): 2, ("x", "c"): 3, ("x", "d"): 4, ("y", "1"): 1, ("y", "3"): 2, ("y", "2"): 3, ("y", "9"): 4}
        other = spark.createDataFrame([("a",), ("z",), (None,), ("b",)], "x string")
        keyed = cleaning.as_category(other, "x", cleaning.by_appearance(df, ["x", "y"]))
        assert sorted((str(r.x), r.x_key) for r in keyed.collect()) == [("None", 6), ("a", 2), ("b", 1), ("z", 5)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")

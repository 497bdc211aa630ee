from pyspark.sql import functions as F

from cohortlib import ADULT, CHILD, Bands
from cohortlib import functions as fn

import pytest


def column(spark, values, schema="x string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def apply(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_band_covers_every_cut_and_null(spark):
    df = column(spark, [None, 18, 25, 26, 35, 36, 45, 46, 55, 56], "x int")
    assert apply(df, fn.banded("x", ADULT.age_cat)) == [
        None, "18 to 25", "18 to 25", "26 to 35", "26 to 35", "36 to 45", "36 to 45", "46 to 55", "46 to 55", "56+"]
    assert apply(column(spark, [10, 11, 13, 14, 20], "x int"), fn.banded("x", CHILD.age_cat)) == [
        "10 and under", "11 to 13", "11 to 13", "14 to 17", "14 to 17"]


def test_band_null_label(spark):
    df = column(spark, [None, 182, 183], "x int")
    assert apply(df, fn.banded("x", ADULT.elig_cat)) == ["No Elig", "Less than 50%", "50% +"]
    assert apply(df, fn.banded("x", CHILD.elig_cat)) == ["Less than 50%", "Less than 50%", "50% +"]


def test_bands_are_checked():
    with pytest.raises(ValueError):
        Bands((1, 2), ("a", "b"))
    with pytest.raises(ValueError):
        Bands((2, 1), ("a", "b", "c"))


def test_map_values_and_recode(spark):
    df = column(spark, ["WHITE", "ASIAN", "UNKNOWN", None])
    mapping = {"WHITE": "White", "ASIAN": "Other"}
    assert apply(df, fn.map_values("x", mapping)) == ["White", "Other", None, None]
    assert apply(df, fn.map_values("x", mapping, "?")) == ["White", "Other", "?", None]
    assert apply(df, fn.recode("x", mapping)) == ["White", "Other", "UNKNOWN", None]


def test_three_valued_flags(spark):
    df = spark.createDataFrame([("Y", None), ("N", "Y"), ("N", "N"), ("N", None), (None, None)], "a string, b string")
    assert apply(df, fn.any_flag(["a", "b"], "Y", "yes", "no")) == ["yes", "yes", "no", None, None]
    assert apply(df, fn.is_in("a", ["Y"])) == [True, False, False, False, False]
    assert apply(df, fn.true_only(F.col("b") == "Y")) == [False, True, False, False, False]


def test_strict_sum_is_null_with_any_null(spark):
    df = spark.createDataFrame([("m1", None), ("m1", 1), ("m2", 2)], "m string, v int")
    assert {r["m"]: r["s"] for r in df.groupBy("m").agg(fn.strict_sum("v").alias("s")).collect()} == {"m1": None, "m2": 2}


def test_concat_na_writes_na(spark):
    df = spark.createDataFrame([("After", "After Service", None, None)], "a string, b string, c string, d string")
    assert apply(df, fn.concat_na("_", ["a", "b", "c", "d"])) == ["After_After Service_NA_NA"]


def test_rate_rounding_and_text(spark):
    df = spark.createDataFrame([(6, 0), (6, 60)], "d int, s int")
    assert apply(df, fn.rate_per("d", "s", 30)) == [None, 3.0]
    assert apply(column(spark, [0.25, 12.35], "x double"), fn.round_half_even("x", 1)) == [0.2, 12.4]
    assert apply(column(spark, [0.256], "x double"), fn.percent_text("x")) == ["25.6%"]
    assert apply(column(spark, ["(100-1) ACUTE HOSPITAL"]), fn.first_word("x")) == ["(100-1)"]


def test_level_key_and_no_yes(spark):
    df = column(spark, ["b", "a", "z", None])
    assert apply(df, fn.level_key("x", ["b", "a"])) == [1, 2, 3, 4]
    assert apply(column(spark, [0, 1, 2, None], "x int"), fn.no_yes("x")) == ["No", "Yes", None, None]
    assert apply(column(spark, [None, 0, 5], "x int"), fn.used_flag("x")) == ["No", "Yes", "Yes"]

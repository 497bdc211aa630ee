"""Service use before and after the index episode.

All reports share one shape: slice the long table to a measure (directory and filter pushdown), add
up each member's lines, then summarise over members. The first step shrinks the data to one row per
member and level of care; the second combines on the map side, so a level of care used by nearly
everyone does not gather its members in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortlib.functions import banded, discharge_year, is_in, rate_per, row_count
from cohortlib.operators.reshape import long_again, member_days
from cohortlib.spec import ELIG_DAY_BANDS, ELIG_YEAR_BANDS, MEMBER, RunSpec

DIMS = ("BA_Category", "Measure_Name", "Measure_Period", "LOC")


def slice_measure(long: DataFrame, ba: str, measure: str, period: str | None = None,
                  with_period: bool = False) -> DataFrame:
    """Lines of one measure, of one period, or of any known period."""
    out = long.where(is_in("BA_Category", [ba]) & is_in("Measure_Name", [measure]))
    if period is not None:
        out = out.where(is_in("Measure_Period", [period]))
    return out.where(F.col("Measure_Period").isNotNull()) if with_period else out


def _percent(denominator: Column) -> Column:
    return (F.try_divide(row_count(), denominator) * 100).alias("Perc_UsingService")


def _ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """Display order by a falling measure; names break ties. Runs over one row per category."""
    return df.withColumn("display_rank", F.row_number().over(W.orderBy(F.desc_nulls_last(by), F.asc_nulls_last(name))))


def service_summary(long: DataFrame, denominator: Column) -> DataFrame:
    """Users, mean and median days per measure, period and level of care."""
    days = member_days(long, DIMS)
    return days.groupBy(*DIMS).agg(
        row_count().alias("N_UsingService"), F.avg("Days").alias("AvgDays"), F.percentile("Days", 0.5).alias("MedDays"),
        _percent(denominator))


def after_summary(long: DataFrame, denominator: Column, per: int = 100) -> DataFrame:
    """Users after discharge and mean days of service per ``per`` days in the community."""
    days = member_days(slice_measure(long, "After", "After Service"), (*DIMS, "SurvivalDays"))
    rated = days.withColumn("rate", rate_per("Days", "SurvivalDays", per))
    return rated.groupBy(*DIMS).agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("rate").alias(f"AvgRateDays{per}"))


def after_use_by_loc(long: DataFrame, denominator: Column) -> DataFrame:
    """Percent of members using each level of care after discharge (no level of care = no service)."""
    days = member_days(slice_measure(long, "After", "After Service"), ("LOC", "SurvivalDays"))
    rated = days.withColumn("rate", rate_per("Days", "SurvivalDays", 30))
    out = rated.groupBy("LOC").agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("rate").alias("AvgRateDays30"))
    return _ranked(out, "Perc_UsingService", "LOC")


def after_days_by_loc(long: DataFrame, denominator: Column) -> DataFrame:
    """Mean days per 30 days in the community, per level of care used after discharge."""
    out = after_summary(long.where(F.col("LOC").isNotNull()), denominator, per=30)
    return _ranked(out, "AvgRateDays30", "LOC")


def prior_use_by_loc(long: DataFrame, denominator: Column, spec: RunSpec) -> DataFrame:
    """Percent of members using each level of care in the year before admission."""
    days = member_days(slice_measure(long, "Before", "Prior Service", "Year 1"), ("LOC", "SurvivalDays"))
    rated = days.withColumn("rate", rate_per("Days", spec.year_days, 30))
    out = rated.groupBy("LOC").agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("Days").alias("AvgDays"),
        F.avg("rate").alias("AvgRateDays30"))
    return _ranked(out, "Perc_UsingService", "LOC")


def prior_days_by_loc(long: DataFrame, denominator: Column, spec: RunSpec) -> DataFrame:
    """As ``prior_use_by_loc``, in the order of mean days."""
    return _ranked(prior_use_by_loc(long, denominator, spec).drop("display_rank"), "AvgDays", "LOC")


def _by_facets(lines: DataFrame, spec: RunSpec, keys: Sequence[str], name: str = "Days") -> DataFrame:
    """Days per member with year of discharge, readmission and, for children, DHS status."""
    lines = lines.withColumn("yearDC", discharge_year("ServiceEnd"))
    return member_days(lines, (*keys, "SurvivalDays", *spec.facets), name=name)


def after_distribution(long: DataFrame, spec: RunSpec) -> DataFrame:
    lines = slice_measure(long, "After", "After Service").where(F.col("LOC").isNotNull())
    return _by_facets(lines, spec, ("LOC",)).withColumn("RateDays30", rate_per("Days", "SurvivalDays", 30))


def prior_distribution(long: DataFrame, spec: RunSpec) -> DataFrame:
    lines = slice_measure(long, "Before", "Prior Service", "Year 1").where(F.col("LOC").isNotNull())
    return _by_facets(lines, spec, ("LOC",))


def eligibility_distribution(long: DataFrame, spec: RunSpec) -> DataFrame:
    return _by_facets(slice_measure(long, "Before", "Eligibility"), spec, ("Measure_Period",))


def dhs_distribution(long: DataFrame, spec: RunSpec) -> DataFrame:
    return _by_facets(slice_measure(long, "Before", "DHS"), spec, ("Measure_Period",))


def ip_distribution(long: DataFrame, spec: RunSpec) -> DataFrame:
    lines = slice_measure(long, "Before", "IP Discharges", with_period=True)
    return _by_facets(lines, spec, ("Measure_Period",), name="NAIPDc")


def eligibility_at_least(long: DataFrame, denominator: Column, spec: RunSpec, days: int = 300) -> DataFrame:
    """Members with at least ``days`` eligible days, per prior year."""
    per_member = member_days(slice_measure(long, "Before", "Eligibility"), ("Measure_Period", "SurvivalDays"))
    rated = per_member.where(F.col("Days") >= days).withColumn("rate", rate_per("Days", spec.year_days, 30))
    return rated.groupBy("Measure_Period").agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("rate").alias("AvgRateDays30"))


def _share_within(counts: DataFrame, group: str) -> DataFrame:
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def eligibility_bands(long: DataFrame) -> DataFrame:
    """Bands of eligible days among members with eligibility, and their share within each year."""
    per_member = member_days(slice_measure(long, "Before", "Eligibility"), ("Measure_Period", "SurvivalDays"))
    counts = per_member.groupBy("Measure_Period", banded("Days", ELIG_DAY_BANDS).alias("EligCat")).agg(row_count().alias("n"))
    return _share_within(counts, "Measure_Period")


def eligibility_bands_all(wide: DataFrame, spec: RunSpec) -> DataFrame:
    """Eligibility bands of all member rows per prior year; no eligible day is a band of its own."""
    cols = [f"Yr{y}Prior_Elig" for y in spec.years]
    days = long_again(wide, cols, "prior_year", "days")
    year = F.concat(F.lit("Year "), F.regexp_extract("prior_year", r"Yr(\d+)", 1))
    counts = days.groupBy(year.alias("Measure_Period"), banded("days", ELIG_YEAR_BANDS).alias("Elig_Cat")).agg(row_count().alias("n"))
    return _share_within(counts, "Measure_Period")


def ip_by_year(long: DataFrame, denominator: Column, spec: RunSpec) -> DataFrame:
    """Members with inpatient discharges and the mean number, per prior year."""
    return ip_distribution(long, spec).groupBy("Measure_Period").agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("NAIPDc").alias("AvgNDCs"))


def dhs_by_year(long: DataFrame, denominator: Column, spec: RunSpec) -> DataFrame:
    """Members with DHS involvement, mean days and days per month, per prior year."""
    days = member_days(slice_measure(long, "Before", "DHS"), ("Measure_Period", "SurvivalDays"))
    rated = days.withColumn("rate", rate_per("Days", spec.year_days, 30))
    return rated.groupBy("Measure_Period").agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("Days").alias("AvgDays"),
        F.avg("rate").alias("AvgRateDays30"))


def additional_services(long: DataFrame, denominator: Column, spec: RunSpec) -> DataFrame:
    """Members using additional services and their mean days."""
    period = None if spec.additional_by_period else "Year 1"
    keys = ("Measure_Period", "LOC") if spec.additional_by_period else ("LOC",)
    days = member_days(slice_measure(long, "Before", "Additional Service", period), (*keys, "SurvivalDays"))
    return days.groupBy(*keys).agg(
        row_count().alias("N_UsingService"), _percent(denominator), F.avg("Days").alias("AvgDays"))


def members_in(long: DataFrame) -> DataFrame:
    """Rows and distinct members of a long table."""
    return long.agg(row_count().alias("n_rows"), F.count_distinct(MEMBER).alias("n_members"))


SKETCH_BITS = 12                                           # 4,096 registers
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)               # relative standard error of an estimate from united sketches


def member_sketches(long: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Rows and a HyperLogLog sketch of the members of each combination of ``dims``. Written once, the sketches answer
    distinct counts over any coarser grouping without another look at the lines; a sketch has a few KB at any size."""
    return long.groupBy(*dims).agg(row_count().alias("n_rows"), F.hll_sketch_agg(F.col(MEMBER), SKETCH_BITS).alias("sketch"))


def estimated_members(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and estimated distinct members by some of the sketches' dimensions: sketches are united, members counted in several
    of them count once. The standard error is ``SKETCH_ERROR`` of the count; rows are exact."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"),
                                     F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_members_estimated"))

"""Long to wide: one row per member with one named column per measure, period and level of care."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.functions import any_flag, banded, concat_na, if_known, strict_sum, used_flag
from cohortlib.spec import AUTH, MEMBER, RunSpec


def member_days(df: DataFrame, keys: Sequence[str], value: str = "Day_Count", name: str = "Days",
                strict_null: bool = True) -> DataFrame:
    """Sum per member and keys, because a member can have several lines for one level of care."""
    total = strict_sum(value) if strict_null else F.sum(value)
    return df.groupBy(MEMBER, *keys).agg(total.alias(name))


def wide_names(spec: RunSpec) -> dict[str, str]:
    """Joined dimension text -> short column name, for every column of the wide table."""
    after = spec.after_period
    names = {f"After_After Service_{after}_{loc}": f"After_{short}" for loc, short in spec.service_groups}
    names[f"After_IP Admissions_{after}_IP"] = "N_AIPAdmits_1YrAfter"
    with_dhs = "Yr1Prior_DHS" in spec.extra_model
    for y in spec.years:
        for loc, short in spec.additional_groups:
            names[f"Before_Additional Service_Year {y}_{loc}"] = f"Yr{y}Prior_{short}"
        if with_dhs:
            names[f"Before_DHS_Year {y}_NA"] = f"Yr{y}Prior_DHS"
        names[f"Before_Eligibility_Year {y}_NA"] = f"Yr{y}Prior_Elig"
        names[f"Before_IP Discharges_Year {y}_IP"] = f"N_AIPDC_{y}YrPrior"
        for loc, short in spec.service_groups:
            names[f"Before_Prior Service_Year {y}_{loc}"] = f"Yr{y}Prior_{short}"
    return names


def unite(df: DataFrame, name: str, cols: Sequence[str], sep: str = "_") -> DataFrame:
    """Join columns into one text column; a missing part reads NA."""
    return df.withColumn(name, concat_na(sep, cols)).drop(*cols)


def spread(df: DataFrame, key: str, value: str, names: dict[str, str]) -> DataFrame:
    """Long to wide over a declared value list: no job to discover the keys, and the result has the
    same columns whatever the data holds."""
    wide = df.groupBy(MEMBER).pivot(key, list(names)).agg(F.first(value))
    return wide.withColumnsRenamed(names)


def unlisted_wide_keys(long: DataFrame, spec: RunSpec) -> DataFrame:
    """Keys of the long table that have no column in the wide one, with their lines and days. ``known_empty`` marks the
    empty lines (no period and no days) that members without a grouped line get; any other key is one that ``found_wide_keys`` adds."""
    united = unite(long.select("BA_Category", "Measure_Name", "Measure_Period", "LOC", "Day_Count",
                               F.col("Measure_Period").isNull().alias("empty")), "TimeLOC", ["BA_Category", "Measure_Name", "Measure_Period", "LOC"])
    out = united.where(~F.col("TimeLOC").isin(*wide_names(spec))).groupBy("TimeLOC").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("Day_Count").alias("days"), F.bool_and("empty").alias("empty"))
    return out.select("TimeLOC", "n_lines", "days", (F.col("empty") & (F.coalesce("days", F.lit(0)) == 0)).alias("known_empty"))


#: Most columns beside the declared ones that a wide table gets.
MOST_FOUND = 1000


def found_wide_keys(long: DataFrame, spec: RunSpec) -> list[str]:
    """Keys with days that have no declared column, sorted: from one pass over the distinct keys. More than MOST_FOUND are an error,
    as they are no dimensions but values."""
    rows = unlisted_wide_keys(long, spec).where("NOT known_empty").select("TimeLOC").limit(MOST_FOUND + 1).collect()
    if len(rows) > MOST_FOUND:
        raise ValueError(f"more than {MOST_FOUND} keys without a column in the wide table, such as {rows[0]['TimeLOC']!r}")
    return sorted(r["TimeLOC"] for r in rows)


def wide_days(long: DataFrame, spec: RunSpec, found: Sequence[str] = ()) -> DataFrame:
    """Day counts per member, one column per measure, period and level of care; ``found`` keys come after the declared ones, under
    their joined text.

    Lines that are bucketed by member are summed, pivoted and joined to the member table without exchange; a member's
    lines are bounded by the dimensions."""
    lines = long.select(MEMBER, "BA_Category", "Measure_Name", "Measure_Period", "LOC", "Day_Count")
    united = unite(lines, "TimeLOC", ["BA_Category", "Measure_Name", "Measure_Period", "LOC"])
    days = member_days(united, ["TimeLOC"], name="NDays")
    return spread(days, "TimeLOC", "NDays", wide_names(spec) | {k: k for k in found})


def wide_members(long: DataFrame, members: DataFrame, spec: RunSpec, found: Sequence[str] = ()) -> DataFrame:
    """Every member row with its day counts; a member with several attribute rows keeps them all."""
    return attach_member(wide_days(long, spec, found), members)


def attach_member(wide: DataFrame, members: DataFrame) -> DataFrame:
    return wide.join(members, MEMBER, "right")


def drop_matching(df: DataFrame, prefixes: Iterable[str] = (), suffixes: Iterable[str] = ()) -> DataFrame:
    prefixes, suffixes = tuple(prefixes), tuple(suffixes)
    return df.drop(*[c for c in df.columns if (prefixes and c.startswith(prefixes)) or (suffixes and c.endswith(suffixes))])


def used_flags(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: used_flag(c) for c in cols})


def long_again(df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long for the listed columns, keeping missing values."""
    return df.unpivot([MEMBER], list(cols), name, value)


def model_table(wide: DataFrame, spec: RunSpec) -> DataFrame:
    """Categorical covariates, follow-up time and the 0/1 readmission indicator per member row."""
    adult = spec.name == "adult"
    df = wide.drop("N_AIPAdmits_1YrAfter", AUTH, "Readmit_Auth", "Readmit_SB",
                   *[f"N_AIPDC_{y}YrPrior" for y in spec.years if y > 1])
    df = drop_matching(df, [f"Yr{y}" for y in spec.years if y > 1], [short for _, short in spec.additional_groups])
    derived = {
        "Yr1Prior_AnyAIP": used_flag("N_AIPDC_1YrPrior"),
        "LOScat": banded("LOS", spec.los_cat),
        "eligcat": banded("Yr1Prior_Elig", spec.elig_cat),
        "Flag_Readmit": (F.col("Flag_Readmit") == "Yes").cast("int"),
    }
    if not adult:
        age_name, bands = spec.age_model
        derived[age_name] = banded("Age", bands)
        derived["ASDID"] = any_flag(["ASD_Measure_Year", "ID_Measure_Year"], "Y", "ASD or ID", "No ASD or ID")
        derived["Voluntary"] = if_known(F.col("LOC_Label") == spec.voluntary_label, "Voluntary", "Involuntary")
    services = [c for c in df.columns if c.startswith("After_") or c.startswith("Yr1Prior_")]
    counts = [c for c in services if c != "Yr1Prior_Elig"]
    df = used_flags(df.withColumns(derived), counts)
    return df.drop("Yr1Prior_Elig", "ASD_Measure_Year", "ID_Measure_Year", "N_AIPDC_1YrPrior", "LOC_Label")

"""Frequency tables, summary statistics, box-plot statistics, histograms and report tables.

Tables over categories first count each category (combined on the map side) and do all
further work on those few rows, so one very frequent category costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortlib.functions import any_flag, banded, first_word, level_key, recode, round_half_even, row_count
from cohortlib.operators.quantiles import quantiles
from cohortlib.spec import MEMBER, MONTH_BANDS, WEEK_BANDS, Bands, RunSpec


def freq_pct(df: DataFrame, dim: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Count and percent per value, a missing value being a group of its own.

    ``display_rank`` follows the declared level order, or falling counts when none is given."""
    counts = df.groupBy(dim).agg(row_count().alias("n"))
    by = [level_key(dim, levels), F.col(dim)] if levels else [F.desc("n"), F.asc_nulls_last(dim)]
    return counts.select(
        dim, "n", (F.col("n") / F.sum("n").over(W.partitionBy()) * 100).alias("percent"),
        F.row_number().over(W.orderBy(*by)).alias("display_rank"))


def loc_distribution(members: DataFrame) -> DataFrame:
    """Share of index episodes per level of care, with the short code of each."""
    return freq_pct(members, "LOC_Label").withColumn("LOC", first_word("LOC_Label"))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Count per value; missing values are left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(row_count().alias("n"))


def share_table(df: DataFrame, col: str, digits: int | None = 2) -> DataFrame:
    """Count and share per category, missing included; percent to ``digits`` or a plain fraction."""
    counts = df.groupBy(col).agg(row_count().alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return counts.select(col, "n", (share if digits is None else round_half_even(share * 100, digits)).alias("perc"))


def summary_columns(value: str, suffix: str, mode: bool = True) -> list[Column]:
    """Mean, median, mode (smallest of several), sample deviation, interquartile range, extremes."""
    out = [F.avg(value).alias(f"Avg{suffix}"), F.percentile(value, 0.5).alias(f"Med{suffix}")]
    if mode:
        out.append(F.mode(value, True).alias(f"Mode{suffix}"))
    return out + [
        F.stddev_samp(value).alias(f"SD{suffix}"),
        (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias(f"IQR{suffix}"),
        F.min(value).alias(f"min{suffix}"), F.max(value).alias(f"max{suffix}")]


def num_summary(df: DataFrame, value: str, by: Sequence[str] = (), suffix: str = "", mode: bool = True) -> DataFrame:
    return df.groupBy(*by).agg(*summary_columns(value, suffix, mode))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Box-plot statistics per group: quartiles, whiskers at the furthest values within 1.5
    interquartile ranges, outliers beyond them, and the notch around the median.

    Works on the distinct values of each group with their counts, and never gathers them (see ``quantiles``). Values are compared with the fences
    at nine decimals, so a value that equals a fence is not lost to binary rounding.
    """
    keys = list(by) or ["all_rows"]
    df = df if by else df.withColumn("all_rows", F.lit("all"))
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(row_count().alias("k"))
    mean = (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean")
    quart = quantiles(freq, keys, (0.25, 0.5, 0.75)).select(
        *[F.col(c).alias(f"q_{c}") for c in keys], F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    same = None
    for c in keys:
        hit = F.col(c).eqNullSafe(F.col(f"q_{c}"))
        same = hit if same is None else same & hit
    iqr = F.col("q3") - F.col("q1")
    v = F.round(F.col("v").cast("double"), 9)
    inside = (v >= F.round(F.col("q1") - 1.5 * iqr, 9)) & (v <= F.round(F.col("q3") + 1.5 * iqr, 9))
    out = (freq.join(quart, same)
           .groupBy(*keys, "q1", "median", "q3")
           .agg(F.sum("k").alias("n"), mean, F.min(F.when(inside, F.col("v"))).cast("double").alias("lower_whisker"),
                F.max(F.when(inside, F.col("v"))).cast("double").alias("upper_whisker"),
                F.sum(F.when(inside, 0).otherwise(F.col("k"))).alias("n_outliers")))
    half_notch = 1.58 * iqr / F.sqrt("n")
    return out.select(
        *by, "n", "mean", "lower_whisker", "q1", "median", "q3", "upper_whisker", "n_outliers",
        (F.col("median") - half_notch).alias("notch_low"), (F.col("median") + half_notch).alias("notch_high"))


def box_by_loc(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Box-plot statistics by level of care (and more groups), with the display order of the levels of care: falling
    mean over all groups, names break ties."""
    order = df.where(F.col(value).isNotNull()).groupBy(F.col("LOC").alias("_loc")).agg(F.avg(value).alias("m"))
    rank = F.row_number().over(W.orderBy(F.desc(F.round("m", 9)), F.asc_nulls_last("_loc"))).alias("display_rank")
    return (box_stats(df, value, ["LOC", *by]).join(order.select("_loc", rank), F.col("LOC").eqNullSafe(F.col("_loc"))).drop("_loc"))


def histogram(df: DataFrame, col: str, lo: float, width: float, bins: int) -> DataFrame:
    """Right-closed bins, the first closed on both sides. Empty bins are listed. Bin 0 counts what is below the first
    bin and bin ``bins + 1`` what is above the last, so no value is left out; nulls are not counted."""
    spark = df.sparkSession
    v = F.col(col)
    bin_no = F.when(v < lo, 0).otherwise(F.least(F.greatest(F.lit(1), F.ceil((v - lo) / width)), F.lit(bins + 1))).cast("int")
    counted = df.where(v.isNotNull()).groupBy(bin_no.alias("bin")).agg(row_count().alias("k"))
    frame = spark.range(0, bins + 2).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: lo + i * F.lit(float(width))
    return frame.join(counted, "bin", "left").select(
        "bin", F.when(F.col("bin") > 0, edge(F.col("bin") - 1)).alias("lo"), F.when(F.col("bin") <= bins, edge(F.col("bin"))).alias("hi"),
        F.coalesce("k", F.lit(0)).alias("n"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 4) -> DataFrame:
    """Per column: missing, distinct values, and the most frequent values. One pass over the rows;
    the row limit per column is applied before the exchange of the ranking."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cols]
    counts = df.select(F.inline(F.array(*pairs))).groupBy("variable", "value").agg(row_count().alias("k"))
    totals = counts.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"))
    # Missing values rank last instead of being filtered first, so both branches share one exchange.
    rank = F.row_number().over(W.partitionBy("variable").orderBy(F.col("value").isNull(), F.desc("k"), "value"))
    top = (counts.withColumn("r", rank).where(F.col("r") <= k).where(F.col("value").isNotNull())
           .groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("r", "value", "k"))).alias("top")))
    text = F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit(": "), x["k"].cast("string"))), ", ")
    return totals.join(top, "variable", "left").select("variable", "n_missing", "n_unique", text.alias("top_counts"))


def profile(df: DataFrame, text_cols: Sequence[str], number_cols: Sequence[str]) -> DataFrame:
    """Column profile: missing and distinct counts and top values for every column, and mean,
    deviation and percentiles for the numeric ones."""
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    aggs = []
    for c in number_cols:
        aggs.append(F.struct(F.lit(c).alias("variable"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                             F.percentile(c, F.array(*[F.lit(p) for p in points])).alias("p")))
    numbers = df.agg(F.array(*aggs).alias("s")).select(F.inline("s")).select(
        "variable", "mean", "sd", *[F.col("p")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(points)])
    return top_values(df, [*text_cols, *number_cols]).join(numbers, "variable", "left")


# ---- report tables --------------------------------------------------------------------------------

def _stacked(df: DataFrame, sections: Sequence[tuple[str, Column, Sequence[str] | None]], name: str) -> DataFrame:
    """Frequency tables of several dimensions under each other, from one pass over the rows.

    One grouping set for each dimension: rows are counted per dimension before they are shuffled, so what is shuffled is
    as many rows as the dimensions have values, not as there are combinations of these. ``grouping_id`` names the set of a
    count, which tells a missing category from a dimension that the set does not group by."""
    dims = [f"d{i}" for i in range(len(sections))]
    cubed = df.select(*[c.alias(d) for d, (_, c, _) in zip(dims, sections)]).groupingSets([[F.col(d)] for d in dims], *dims).agg(
        row_count().alias("n"), F.grouping_id(*dims).alias("set"))
    everything = (1 << len(dims)) - 1
    parts = None
    for i, (d, (title, _, levels)) in enumerate(zip(dims, sections), 1):
        key = level_key(d, levels) if levels else F.lit(0)
        part = F.struct(F.lit(i).alias("section_no"), F.lit(title).alias("section"), F.col(d).alias(name), key.alias("level_no"))
        own = F.col("set") == everything - (1 << len(dims) - i)
        parts = F.when(own, part) if parts is None else parts.when(own, part)
    counts = cubed.select(parts.alias("part"), "n").select("part.*", "n")
    of_section = W.partitionBy("section_no")
    order = of_section.orderBy("level_no", F.desc("n"), F.asc_nulls_last(name))
    return counts.select(
        "section_no", "section", name, "n",
        round_half_even(F.col("n") / F.sum("n").over(of_section) * 100, 1).alias("percent"),
        F.row_number().over(order).alias("display_rank"))


def demographics_table(members: DataFrame, spec: RunSpec) -> DataFrame:
    diagnosis = any_flag(["ASD_Measure_Year", "ID_Measure_Year"], "Y", "ASD or ID", "No ASD or ID")
    sections = [
        ("Gender", F.col("Gender_Label"), spec.gender_levels),
        ("Age at Admission", F.col("AgeCat"), spec.age_cat.labels),
        ("Race", F.col("RaceCat"), None),
        ("Does member have SA hx", recode("MH_SA", {"MH": "No", "SA": "Yes"}), None)]
    if spec.name == "child":
        sections += [("ASD diagnosis", recode("ASD_Measure_Year", {"N": "No ASD", "Y": "ASD Dx"}), None),
                     ("ID diagnosis", recode("ID_Measure_Year", {"N": "No ID", "Y": "ID Dx"}), None)]
    sections.append(("Does member have ASD and/or ID diagnosis", diagnosis, None))
    return _stacked(members, sections, "Demos")


def service_history_table(members: DataFrame, spec: RunSpec) -> DataFrame:
    loc = spec.index_loc
    sections = [(f"Is this the member's first {loc} episode",
                 recode("FirstEpEver", {"N": f"Had an earlier {loc} episode", "Y": f"First {loc} ever"}), None)]
    if spec.flags:
        sections += [
            ("Is member DHS involved at time of Index Episode",
             recode("Flag_Active_DHS_Status", {"No": f"No DHS during {loc}", "Yes": f"DHS during {loc}"}), None),
            ("Member's BHRS history at time of Index Episode",
             recode("Flag_BHRS_18plus_Mths_Before_Admission",
                    {"No": "Does not have BHRS episode >= 18 months", "Yes": "Has BHRS episode >= 18 months"}), None)]
    sections.append((f"Does member readmit to {loc} within {spec.follow_up_days} days",
                     recode("Flag_Readmit", {"No": "No Readmit", "Yes": f"Readmit within {spec.follow_up_days}"}), None))
    return _stacked(members, sections, "ServUtil")


def los_readmit_table(members: DataFrame) -> DataFrame:
    """Length of stay overall and by readmission, and days to readmission, rounded to one decimal."""
    by_readmit = F.when(F.col("Flag_Readmit") == "No", F.struct(F.lit(2).alias("row_no"),
                        F.lit("LOS for those that did not readmit").alias("Measure"), F.col("LOS").alias("days")))
    by_readmit = by_readmit.otherwise(F.struct(F.lit(3).alias("row_no"),
                        F.lit("LOS for those that did readmit").alias("Measure"), F.col("LOS").alias("days")))
    overall = F.struct(F.lit(1).alias("row_no"), F.lit("Overall LOS").alias("Measure"), F.col("LOS").alias("days"))
    until = F.struct(F.lit(4).alias("row_no"), F.lit("Days to Readmission").alias("Measure"),
                     F.col("Days_to_Readmit").alias("days"))
    rows = members.select(F.inline(F.array(overall, by_readmit, until))).where(F.col("days").isNotNull())
    out = num_summary(rows, "days", ("row_no", "Measure"), "Days", mode=False)
    return out.withColumns({c: round_half_even(c, 1) for c in ("AvgDays", "MedDays", "SDDays", "IQRDays")})


def fast_facts(wide: DataFrame, spec: RunSpec, na_rows: str = "drop") -> DataFrame:
    """The figures quoted in the report, one row each, from a single pass over the member rows.

    Percentages count true conditions only; a missing value counts in the denominator. With ``na_rows="count"`` a row whose
    condition is unknown counts as if it were true, as it does when rows are picked by a condition with missing values."""
    if na_rows not in ("drop", "count"):
        raise ValueError("na_rows is 'drop' or 'count'")
    rows = row_count()
    yes = F.col("Flag_Readmit") == "Yes"
    known = (lambda c: c) if na_rows == "drop" else (lambda c: F.coalesce(c, F.lit(True)))
    pct = lambda cond: F.count_if(known(cond)) / rows * 100
    facts = {
        "members": rows.cast("double"),
        "pct_male": pct(F.col("Gender_Label") == "Male"),
        "pct_female": pct(F.col("Gender_Label") == "Female"),
        "mean_age": F.avg("Age"),
        "median_age": F.percentile("Age", 0.5),
        "pct_white": pct(F.col("RaceCat") == "White"),
        "pct_black": pct(F.col("RaceCat") == "Black"),
        "pct_hispanic": pct(F.col("RaceCat") == "Hispanic"),
        "pct_asd": pct(F.col("ASD_Measure_Year") == "Y"),
        "pct_id": pct(F.col("ID_Measure_Year") == "Y"),
        "pct_sa": pct(F.col("MH_SA") == "SA"),
        "pct_voluntary": pct(F.col("LOC_Label") == spec.voluntary_label),
        "pct_first_ever": pct(F.col("FirstEpEver") == "Y"),
        "median_los": F.percentile("LOS", 0.5),
        "mean_los": F.avg("LOS"),
        "min_los": F.min("LOS").cast("double"),
        "max_los": F.max("LOS").cast("double"),
        "max_survival_days": F.max("SurvivalDays").cast("double"),
        "pct_readmit": pct(yes),
        "pct_readmit_30": pct(yes & (F.col("SurvivalDays") <= 30)),
        "pct_readmit_60": pct(yes & (F.col("SurvivalDays") <= 60)),
        "mean_days_to_readmit": F.avg("Days_to_Readmit"),
        "pct_of_readmits_30": F.try_divide(F.count_if(yes & (F.col("Days_to_Readmit") <= 30)) * 100.0, F.count_if(yes)),
    }
    if spec.name == "adult":
        facts["pct_age_30_or_less"] = pct(F.col("Age") <= 30)
    else:
        facts["pct_age_14_up"] = pct(F.col("Age") >= 14)
        facts["pct_dhs_now"] = pct(F.col("Flag_Active_DHS_Status") == "Yes")
        facts["pct_dhs_prior_year"] = pct(F.col("Yr1Prior_DHS").isNotNull())
    pairs = [F.struct(F.lit(name).alias("fact"), value.alias("value")) for name, value in facts.items()]
    return wide.agg(F.array(*pairs).alias("f")).select(F.inline("f"))


def readmit_timing(members: DataFrame) -> DataFrame:
    """When members readmit: count and share of readmitters by month and week."""
    days = F.col("Days_to_Readmit")
    counts = (members.where(F.col("Flag_Readmit") == "Yes")
              .groupBy(banded(days, MONTH_BANDS).alias("Readmit_Cat"), banded(days, WEEK_BANDS).alias("Week_Cat"))
              .agg(row_count().alias("n")))
    return counts.select("Readmit_Cat", "Week_Cat", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("perc"))


def band_share(df: DataFrame, value: str, bands: Bands, name: str, digits: int | None = 2) -> DataFrame:
    return share_table(df.select(banded(value, bands).alias(name)), name, digits)


def schema_listing(df: DataFrame) -> DataFrame:
    """Position, name and type of every column; reads no data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def attribute_fanout(members: DataFrame) -> DataFrame:
    """Members with several attribute rows; they appear once per row in the wide table."""
    return members.groupBy(MEMBER).agg(row_count().alias("n")).where(F.col("n") > 1)

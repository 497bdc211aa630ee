"""Named queries over the test tables: one per operator or report, each a DataFrame.

Floating-point results are rounded to six decimals here, at the edge, so that they can be compared
with another engine; the operators themselves do not round.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortlib.functions import any_flag, percent_text
from cohortlib.operators import cleaning, cohort, cox, describe, reshape, survival, utilization
from cohortlib.plans.oracle import COX_CHECKS
from cohortlib.plans.report import hazard_ratios
from cohortlib.plans.study import MEMBERS_PER_PARTITION, Study, study
from cohortlib.sources.extract import EXTRACT_SCHEMA, guess_types, read_extract, read_stage, write_stage
from cohortlib.spec import ADULT, AUTH, CHILD, MEMBER, RunSpec

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(*cols)


def _query(spec: RunSpec, build: Callable[[Study], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(build(study(spark, sf_dir, spec)))


# ---- cohort building, from the raw tables -----------------------------------------------------------

def _windows_of(st: Study) -> DataFrame:
    found = cohort.find_readmission(st.index, st.given.auth, st.spec)
    return cohort.after_window(found, st.spec).select(
        "member", "auth", "sb", "se", "readmit_auth", "readmit_sb", "days_to_readmit", "after_b", "after_e")


def _grouped_services(st: Study) -> DataFrame:
    grouped = cohort.loc_grouping(st.given.services, st.given.loc_dim, st.spec.age_group)
    return grouped.groupBy("code", "LOC").agg(F.count(F.lit(1)).alias("n_lines"))


def _ip_counts(st: Study) -> DataFrame:
    history = cohort.episode_history(st.index, st.inputs.auth, st.spec)
    return history.select("member", "n_adm", *[f"n_dc_{y}" for y in st.spec.years])


def _csv_round_trip(st: Study) -> DataFrame:
    """Deliver the extract as a CSV file, read it back with its schema and clean it."""
    delivered = cohort.as_delivered(st.extract).select(*EXTRACT_SCHEMA.fieldNames())
    path = write_stage(delivered, st.stage_dir, "delivered", fmt="csv")
    return _typed_lines(cleaning.clean_extract(read_extract(st.spark, path), st.spec))


GUESSED = ("AuthorizationNumber", MEMBER, "ServiceBegin", "Gender_Label", "Age", "ASD_Measure_Year", "LOC_Label", "Readmit_SB", "Days_to_Readmit",
           "Measure_Period", "LOC", "Day_Count", "Ep180")


def _guessed_types(st: Study) -> DataFrame:
    """Deliver the extract as a CSV file and guess the types of its columns."""
    path = write_stage(cohort.as_delivered(st.extract).select(*GUESSED), st.stage_dir, "delivered_columns", fmt="csv")
    raw = st.spark.read.csv(path, header=True, nullValue="NA")
    return guess_types(raw).select("column", "type", "n", "n_missing", F.col("unfit.int").alias("not_int"), F.col("unfit.date").alias("not_date"))


APPEARING = ("RaceCat", "AgeCat", "LOC_Label", "MH_SA", "LOS")


def _first_appearance(st: Study) -> DataFrame:
    """Write the member rows over several files in the order of their authorizations, and find the order of levels in these."""
    order = [F.col(AUTH).cast("bigint"), F.col(MEMBER).cast("bigint")]
    files = max(5, math.ceil(st.members.count() / MEMBERS_PER_PARTITION))
    write_stage(st.members.repartitionByRange(files, *order).sortWithinPartitions(*order), st.stage_dir, "in_order")
    return cleaning.by_appearance(read_stage(st.spark, st.stage_dir, "in_order"), APPEARING) 


def _found_columns(st: Study) -> DataFrame:
    """The wide table of a run that declares one level of care less: its days stay, under the joined text of their key."""
    fewer = dataclasses.replace(st.spec, service_groups=st.spec.service_groups[:-1])
    found = reshape.found_wide_keys(st.long, fewer)
    return reshape.wide_days(st.long, fewer, found).select(MEMBER, *found)


def _estimated_members(st: Study) -> DataFrame:
    """Members of each measure, from the sketches of its periods and levels of care, beside the exact count."""
    by = ["BA_Category", "Measure_Name"]
    exact = st.long.groupBy(*by).agg(F.count_distinct(MEMBER).alias("n_members"))
    found = utilization.estimated_members(st.sketches, by)
    off = F.abs(F.col("n_members_estimated") - F.col("n_members"))
    return found.join(exact, [found[c].eqNullSafe(exact[c]) for c in by]).select(
        *(found[c] for c in by), "n_rows", "n_members", (off <= F.ceil(4 * utilization.SKETCH_ERROR * F.col("n_members"))).alias("within_bound"))


def _typed_lines(clean: DataFrame) -> DataFrame:
    return clean.select(
        "AuthorizationNumber", MEMBER, "ServiceBegin", "ServiceEnd", "Gender_Label", "RaceEthnic_Label", "Age",
        "ASD_Measure_Year", "ID_Measure_Year", "LOC_Label", "FirstEpEver", "MH_SA", "Readmit_Auth", "Readmit_SB",
        "Days_to_Readmit", "BA_Category", "Measure_Name", "Measure_Period", "LOC", "Day_Count")


def _cohort() -> dict[str, Query]:
    both = {"adult": ADULT, "child": CHILD}
    out = {
        "index_episodes": _query(ADULT, lambda st: st.index.drop("first_ever")),
        "first_episode_ever": _query(ADULT, lambda st: st.index.select("member", "first_ever")),
        "readmission_windows": _query(ADULT, _windows_of),
        "prior_windows": _query(ADULT, lambda st: cohort.prior_windows(st.index, st.spec)),
        "member_attributes": _query(ADULT, lambda st: st.index.select("member").join(st.given.members, "member", "left")),
        "ip_counts": _query(ADULT, _ip_counts),
        "merged_eligibility": _query(ADULT, lambda st: cohort.merge_spans(st.given.eligibility, ("member",))),
        "eligibility_days": _query(ADULT, lambda st: cohort.covered_days(st.episodes, st.given.eligibility, st.spec)),
        "dhs_days": _query(CHILD, lambda st: cohort.covered_days(st.episodes, st.given.dhs, st.spec)),
        "admission_flags": _query(CHILD, lambda st: cohort.admission_flags(st.episodes, st.inputs)),
        "extract_csv_round_trip": _query(ADULT, _csv_round_trip),
    }
    for name, spec in both.items():
        out[f"loc_grouping_{name}"] = _query(spec, _grouped_services)
        out[f"service_days_{name}"] = _query(
            spec, lambda st: cohort.service_days(st.episodes, st.inputs.services, st.inputs.loc_dim, st.spec))
        out[f"guessed_types_{name}"] = _query(spec, _guessed_types)
        out[f"span_days_{name}"] = _query(spec, lambda st: st.days)
        out[f"additional_days_{name}"] = _query(
            spec, lambda st: cohort.overlap_days(st.given.additional, st.episodes, st.spec, ("LOC",)))
        out[f"extract_{name}"] = _query(spec, lambda st: _typed_lines(st.clean))
    return out


# ---- cleaning -----------------------------------------------------------------------------------------

def _cleaning() -> dict[str, Query]:
    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        out |= {
            f"starting_point_{name}": _query(spec, lambda st: st.start.groupBy(
                "LOS", "Flag_Readmit", "RaceCat", "AgeCat", "SurvivalDays").agg(F.count(F.lit(1)).alias("n_lines"))),
            f"clean_long_{name}": _query(spec, lambda st: st.long.select(
                MEMBER, "BA_Category", "Measure_Name", "Measure_Period", "LOC", "Day_Count", "LOS", "SurvivalDays",
                "Flag_Readmit", *st.spec.flags)),
            f"member_table_{name}": _query(spec, lambda st: st.members),
            f"stage_audit_{name}": _query(spec, lambda st: cleaning.stage_audit(st.start, cleaning.cleaning_steps(st.spec))),
            f"quality_checks_{name}": _query(spec, lambda st: cleaning.quality_checks(cleaning.member_table(st.start), st.spec)),
            f"first_appearance_{name}": _query(spec, _first_appearance),
            f"level_list_{name}": _query(spec, lambda st: cleaning.level_list(
                st.long, ["Measure_Name", "Measure_Period", "LOC", "FirstEpEver", "Flag_Readmit"])),
            f"table_sizes_{name}": _query(spec, lambda st: utilization.members_in(st.long)),
            f"estimated_members_{name}": _query(spec, _estimated_members),
        }
    out["age_level_order"] = _query(ADULT, lambda st: cleaning.as_category(
        st.members, "AgeCat", st.spec.age_cat.labels).select("AgeCat", "AgeCat_key").distinct())
    return out


# ---- description --------------------------------------------------------------------------------------

def _frequencies() -> dict[str, Query]:
    dims = {"gender": "Gender_Label", "age": "AgeCat", "race": "RaceCat", "mh_sa": "MH_SA", "first_episode": "FirstEpEver",
            "readmit": "Flag_Readmit", "asd": "ASD_Measure_Year", "id": "ID_Measure_Year"}
    child = {"bhrs": "Flag_BHRS_18plus_Mths_Before_Admission", "dhs": "Flag_Active_DHS_Status"}
    levels = {"gender": lambda s: s.gender_levels, "age": lambda s: s.age_cat.labels}

    def freq(spec: RunSpec, key: str, col: str) -> Query:
        order = levels[key](spec) if key in levels else None
        return _query(spec, lambda st: describe.freq_pct(st.members, col, order))

    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        for key, col in (dims | (child if spec is CHILD else {})).items():
            out[f"freq_{key}_{name}"] = freq(spec, key, col)
        out[f"freq_loc_{name}"] = _query(spec, lambda st: describe.loc_distribution(st.members))
        out[f"freq_asd_or_id_{name}"] = _query(spec, lambda st: describe.freq_pct(st.members.withColumn(
            "ASDID", any_flag(["ASD_Measure_Year", "ID_Measure_Year"], "Y", "ASD or ID", "No ASD or ID")), "ASDID"))
    return out


def _description() -> dict[str, Query]:
    out = {}
    numbers = ["Age", "LOS", "Days_to_Readmit", "SurvivalDays"]
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        texts = ["Gender_Label", "RaceCat", "AgeCat", "MH_SA", "FirstEpEver", "LOC_Label", "ASD_Measure_Year", MEMBER]
        out |= {
            f"los_by_readmit_{name}": _query(spec, lambda st: describe.num_summary(st.members, "LOS", ["Flag_Readmit"], "LOS")),
            f"los_overall_{name}": _query(spec, lambda st: describe.num_summary(st.members, "LOS", (), "LOS")),
            f"days_to_readmit_{name}": _query(spec, lambda st: describe.num_summary(
                st.members.where(F.col("Days_to_Readmit").isNotNull()), "Days_to_Readmit", ["Flag_Readmit"], "DTR")),
            f"demographics_table_{name}": _query(spec, lambda st: describe.demographics_table(st.members, st.spec)),
            f"service_history_table_{name}": _query(spec, lambda st: describe.service_history_table(st.members, st.spec)),
            f"los_readmit_table_{name}": _query(spec, lambda st: describe.los_readmit_table(st.members)),
            f"fast_facts_{name}": _query(spec, lambda st: describe.fast_facts(st.wide, st.spec)),
            f"fast_facts_na_rows_{name}": _query(spec, lambda st: describe.fast_facts(st.wide, st.spec, na_rows="count")),
            f"readmit_timing_{name}": _query(spec, lambda st: describe.readmit_timing(st.wide)),
            f"profile_{name}": _query(spec, lambda st, t=tuple(texts): describe.profile(st.members, t, numbers)),
            f"los_share_{name}": _query(spec, lambda st: describe.band_share(st.wide, "LOS", st.spec.los_cat, "LOScat")),
            f"eligibility_share_{name}": _query(spec, lambda st: describe.band_share(
                st.wide, "Yr1Prior_Elig", st.spec.elig_explore, "eligcat", None)),
            f"value_counts_los_{name}": _query(spec, lambda st: describe.freq_table(st.wide, "LOS")),
            f"value_counts_age_{name}": _query(spec, lambda st: describe.freq_table(st.wide, "Age")),
            f"value_counts_ip_{name}": _query(spec, lambda st: describe.freq_table(st.wide, "N_AIPDC_1YrPrior")),
            f"hist_eligibility_{name}": _query(spec, lambda st: describe.histogram(st.wide, "Yr1Prior_Elig", 0, 200, 2)),
            f"box_los_overall_{name}": _query(spec, lambda st: describe.box_stats(st.members, "LOS")),
        }
        if spec is ADULT:
            out["box_los_age2_adult"] = _query(ADULT, lambda st: describe.box_stats(st.members, "LOS", ["AgeCat2"]))
        own = {"asd": "ASD_Measure_Year", "dhs": "Flag_Active_DHS_Status"} if spec is CHILD else {}
        for key, col in {"readmit": "Flag_Readmit", "gender": "Gender_Label", "race": "RaceCat", "age": "AgeCat",
                         "first_episode": "FirstEpEver", **own}.items():
            out[f"box_los_{key}_{name}"] = _query(spec, lambda st, c=col: describe.box_stats(st.members, "LOS", [c]))
            if key != "first_episode":
                out[f"box_days_to_readmit_{key}_{name}"] = _query(
                    spec, lambda st, c=col: describe.box_stats(st.members, "Days_to_Readmit", [c]))
    for width, bins in ((7, 42), (10, 30)):
        out[f"hist_los_{width}_child"] = _query(
            CHILD, lambda st, w=width, b=bins: describe.histogram(st.wide, "LOS", 0, w, b))
    return out


# ---- utilization --------------------------------------------------------------------------------------

def _utilization() -> dict[str, Query]:
    u = utilization
    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        out |= {
            f"service_summary_{name}": _query(spec, lambda st: u.service_summary(st.long, st.wide_denominator)),
            f"after_summary_{name}": _query(spec, lambda st: u.after_summary(st.long, st.wide_denominator)),
            f"after_use_by_loc_{name}": _query(spec, lambda st: u.after_use_by_loc(st.long, st.n_members)),
            f"after_days_by_loc_{name}": _query(spec, lambda st: u.after_days_by_loc(st.long, st.n_member_rows)),
            f"after_distribution_{name}": _query(spec, lambda st: u.after_distribution(st.long, st.spec)),
            f"prior_use_by_loc_{name}": _query(spec, lambda st: u.prior_use_by_loc(st.long, st.n_members, st.spec)),
            f"prior_days_by_loc_{name}": _query(spec, lambda st: u.prior_days_by_loc(st.long, st.n_member_rows, st.spec)),
            f"prior_distribution_{name}": _query(spec, lambda st: u.prior_distribution(st.long, st.spec)),
            f"eligibility_distribution_{name}": _query(spec, lambda st: u.eligibility_distribution(st.long, st.spec)),
            f"eligibility_300_{name}": _query(spec, lambda st: u.eligibility_at_least(st.long, st.n_members, st.spec)),
            f"eligibility_bands_{name}": _query(spec, lambda st: u.eligibility_bands(st.long)),
            f"eligibility_bands_all_{name}": _query(spec, lambda st: u.eligibility_bands_all(st.wide, st.spec)),
            f"ip_by_year_{name}": _query(spec, lambda st: u.ip_by_year(st.long, st.n_members, st.spec)),
            f"ip_distribution_{name}": _query(spec, lambda st: u.ip_distribution(st.long, st.spec)),
            f"box_ip_{name}": _query(spec, lambda st: describe.box_stats(
                u.ip_distribution(st.long, st.spec), "NAIPDc", ["Measure_Period"])),
            f"additional_services_{name}": _query(spec, lambda st: u.additional_services(st.long, st.n_members, st.spec)),
        }
        facets = {"": [], "_year": ["yearDC"], "_readmit": ["Flag_Readmit"]}
        if spec is CHILD:
            facets["_dhs"] = ["Flag_Active_DHS_Status"]
        for suffix, cols in facets.items():
            out[f"box_after{suffix}_{name}"] = _query(spec, lambda st, c=tuple(cols): describe.box_by_loc(
                u.after_distribution(st.long, st.spec), "RateDays30", c))
            out[f"box_prior{suffix}_{name}"] = _query(spec, lambda st, c=tuple(cols): describe.box_by_loc(
                u.prior_distribution(st.long, st.spec), "Days", c))
            if suffix != "_dhs":
                out[f"box_eligibility{suffix}_{name}"] = _query(spec, lambda st, c=tuple(cols): describe.box_stats(
                    u.eligibility_distribution(st.long, st.spec), "Days", ["Measure_Period", *c]))
    out |= {
        "dhs_by_year_child": _query(CHILD, lambda st: u.dhs_by_year(st.long, st.n_member_rows, st.spec)),
        "dhs_distribution_child": _query(CHILD, lambda st: u.dhs_distribution(st.long, st.spec)),
        **{f"box_dhs_{key}_child": _query(CHILD, lambda st, c=col: describe.box_stats(
            u.dhs_distribution(st.long, st.spec), "Days", ["Measure_Period", c])) for key, col in
           {"year": "yearDC", "readmit": "Flag_Readmit"}.items()},
        "dhs_use_by_year_child": _query(CHILD, lambda st: u.dhs_by_year(st.long, st.n_members, st.spec)),
        "percent_labels_adult": _query(ADULT, lambda st: describe.readmit_timing(st.wide).select(
            "Readmit_Cat", "Week_Cat", percent_text(F.bround("perc", 3)).alias("label"))),
        "box_dhs_child": _query(CHILD, lambda st: describe.box_stats(
            u.dhs_distribution(st.long, st.spec), "Days", ["Measure_Period"])),
    }
    return out


# ---- modelling ----------------------------------------------------------------------------------------

def _limits(st: Study) -> DataFrame:
    tidy = cox.tidy_cox(st.spark, st.fit)
    return cox.join_estimates(tidy.select("term", "estimate"), tidy.select("term", "conf_low", "conf_high"))


def _small_model(st: Study, names: Sequence[str], ties: str = "efron") -> DataFrame:
    return cox.tidy_cox(st.spark, st.fit_of(names, ties))


def _modelling() -> dict[str, Query]:
    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        out |= {
            f"wide_members_{name}": _query(spec, lambda st: st.wide),
            f"wide_found_columns_{name}": _query(spec, _found_columns),
            f"model_table_{name}": _query(spec, lambda st: st.model),
            f"unlisted_wide_keys_{name}": _query(spec, lambda st: reshape.unlisted_wide_keys(st.long, st.spec)),
            f"cox_hazard_ratios_{name}": _query(spec, hazard_ratios),
            f"cox_significant_{name}": _query(spec, lambda st: survival.significant(hazard_ratios(st))),
            f"cox_glance_{name}": _query(spec, lambda st: cox.cox_glance(st.spark, st.fit).drop("iterations")),
            f"coefficient_limits_{name}": _query(spec, _limits),
            f"unlabelled_terms_{name}": _query(spec, lambda st: survival.unlabelled_terms(hazard_ratios(st))),
            f"attribute_fanout_{name}": _query(spec, lambda st: describe.attribute_fanout(st.members)),
            f"cox_level_counts_{name}": _query(spec, lambda st: cox.level_counts(st.fit)),
        }
        for col in spec.km_strata:
            key = {"Flag_Active_DHS_Status": "dhs"}.get(col, col.lower())
            time = ("SurvivalDays", "Flag_Readmit")
            out |= {
                f"km_{key}_{name}": _query(spec, lambda st, c=col: survival.kaplan_meier(st.model, *time, [c])),
                f"km_median_{key}_{name}": _query(spec, lambda st, c=col: survival.km_median(
                    survival.kaplan_meier(st.model, *time, [c]), [c])),
                f"km_at_30_{key}_{name}": _query(spec, lambda st, c=col: survival.survival_at(
                    survival.kaplan_meier(st.model, *time, [c]), 30, [c])),
                f"logrank_counts_{key}_{name}": _query(spec, lambda st, c=col: survival.logrank_table(st.model, *time, c)),
                f"logrank_{key}_{name}": _query(spec, lambda st, c=col: survival.logrank(st.model, *time, c)),
            }
    out["km_overall_adult"] = _query(ADULT, lambda st: survival.kaplan_meier(st.model, "SurvivalDays", "Flag_Readmit"))
    for key, (spec, names) in COX_CHECKS.items():
        out[key] = _query(spec, lambda st, n=names: _small_model(st, n))
        out[key.replace("cox_", "cox_breslow_")] = _query(spec, lambda st, n=names: _small_model(st, n, "breslow"))
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        out[f"cox_exact_first_episode_{name}"] = _query(spec, lambda st: _small_model(st, ["FirstEpEver"], "exact"))
    out["wide_again_long_adult"] = _query(ADULT, lambda st: reshape.long_again(
        st.wide, [c for c in st.wide.columns if c.startswith("Yr")], "column", "days").where(F.col("days").isNotNull())
        .groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("days").alias("days")))
    return out


def all_queries() -> dict[str, Query]:
    return _cohort() | _cleaning() | _frequencies() | _description() | _utilization() | _modelling()


def readmission_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readmission rate and length of stay by gender, straight from the raw tables."""
    st = study(spark, sf_dir, ADULT)
    found = cohort.find_readmission(st.index, st.given.auth, st.spec)
    rows = found.join(st.given.members, "member", "left").withColumn("LOS", F.datediff("se", "sb")).where(F.col("LOS") > 0)
    stats = describe.summary_columns("LOS", "LOS")
    return rounded(rows.groupBy("Gender_Label").agg(
        F.count(F.lit(1)).alias("n"), F.count("readmit_auth").alias("n_readmit"),
        (F.count("readmit_auth") / F.count(F.lit(1)) * 100).alias("percent_readmit"), *stats))

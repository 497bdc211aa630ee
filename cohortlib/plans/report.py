"""The tables of the short report on one run, with their titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlib.functions import percent_text
from cohortlib.operators import cox, describe, survival, utilization
from cohortlib.plans.study import Study


def hazard_ratios(st: Study) -> DataFrame:
    """The labelled hazard-ratio table of the run's model."""
    tidy = survival.hazard_ratio_columns(cox.tidy_cox(st.spark, st.fit), st.spec.alpha)
    return survival.label_terms(tidy, survival.term_labels(st.spec))


def short_report(st: Study) -> list[tuple[str, DataFrame]]:
    """Facts, length of stay by subgroup, time to readmission, service use after discharge and the
    significant factors. The member and wide tables are staged when the list is made, and the last entry needs the fitted model."""
    spec = st.spec
    age = spec.age_model[0] if spec.name == "adult" else "AgeCat"
    groups = ("RaceCat", age, "FirstEpEver") if spec.name == "adult" else ("ASD_Measure_Year", "Flag_Active_DHS_Status")
    lengths = [("Overall", [])] + [(c, [c]) for c in groups]
    out = [("Fast facts", describe.fast_facts(st.wide, spec))]
    out += [(f"Length of the index stay: {name}", describe.box_stats(st.members, "LOS", by)) for name, by in lengths]
    out += [
        ("Weeks until readmission",
         describe.readmit_timing(st.wide).withColumn("label", percent_text(F.bround("perc", 3)))),
        ("Members with services after discharge", utilization.after_use_by_loc(st.long, st.n_members)),
        (f"Service days after discharge from {spec.index_loc}",
         describe.box_by_loc(utilization.after_distribution(st.long, spec), "RateDays30")),
        (f"Factors of readmission within {spec.follow_up_days} days", survival.significant(hazard_ratios(st))),
    ]
    return out

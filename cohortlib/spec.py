"""Run specification: every window, code set, band, level order and threshold of a cohort run.

Operators take a ``RunSpec`` (or single fields of it) so that one code base serves the adult and the
child cohort. Level orders are declared here because the first level is the reference level of the
hazard model; an order found by scanning would depend on the partitioning of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

MEMBER = "Client_Master_BK"
AUTH = "AuthorizationNumber"

# Service-level columns of the long table; everything else describes the member's index episode.
SERVICE_COLUMNS = ("BA_Category", "Measure_Name", "Measure_Period", "LOC", "Day_Count")


@dataclass(frozen=True)
class Bands:
    """Right-closed bands: ``x <= cuts[i]`` gets ``labels[i]``, larger values the last label."""

    cuts: tuple[float, ...]
    labels: tuple[str, ...]
    null_label: str | None = None

    def __post_init__(self):
        if len(self.labels) != len(self.cuts) + 1:
            raise ValueError("bands need one label more than cuts")
        if list(self.cuts) != sorted(self.cuts):
            raise ValueError("cuts must ascend")


@dataclass(frozen=True)
class Rule:
    """Row exclusion rule: the row matches when every listed column holds one of the values
    (``values``) or is null (``null``)."""

    name: str
    values: tuple[tuple[str, tuple[str, ...]], ...] = ()
    null: tuple[str, ...] = ()


@dataclass(frozen=True)
class Covariate:
    """Categorical model covariate; the first level is the reference level."""

    name: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class RunSpec:
    name: str
    age_group: str
    period_begin: date
    period_end: date
    index_codes: tuple[str, ...]
    readmit_codes: tuple[str, ...]
    loc_labels: tuple[tuple[str, str], ...]
    voluntary_label: str
    min_los: int
    min_readmit_days: int
    quick_readmit_below: int
    age_cat: Bands
    age_model: tuple[str, Bands]
    los_cat: Bands
    elig_cat: Bands
    elig_explore: Bands
    service_groups: tuple[tuple[str, str], ...]
    additional_groups: tuple[tuple[str, str], ...]
    drop_on_entry: tuple[str, ...]
    extra_rules: tuple[Rule, ...]
    facets: tuple[str, ...]
    gender_levels: tuple[str, ...]
    race_levels: tuple[str, ...]
    model_services: tuple[str, ...]
    km_strata: tuple[str, ...]
    wide_denominator: str
    index_loc: str = "AIP"
    follow_up_days: int = 180
    year_days: int = 365
    prior_years: int = 3
    alpha: float = 0.05
    additional_by_period: bool = True
    flags: tuple[str, ...] = ()
    extra_model: tuple[str, ...] = ()
    prior_label: str = "Yr1Prior"
    term_display: tuple[tuple[str, str], ...] = field(default=())

    @property
    def after_period(self) -> str:
        return f"{self.follow_up_days} Days"

    @property
    def years(self) -> range:
        return range(1, self.prior_years + 1)

    @property
    def rules(self) -> tuple[Rule, ...]:
        """Exclusion rules shared by all runs, then those of this run."""
        before, after = ("BA_Category", ("Before",)), ("BA_Category", ("After",))
        return (
            Rule("ungrouped prior service", (before, ("Measure_Name", ("Prior Service",))), ("LOC",)),
            Rule("empty before line", (before,), ("Measure_Period", "LOC")),
            Rule("ungrouped after service",
                 (after, ("Measure_Name", ("After Service",)), ("Measure_Period", (self.after_period,))), ("LOC",)),
            Rule("empty admission line", (after, ("Measure_Name", ("IP Admissions",))), ("Measure_Period",)),
        ) + self.extra_rules

    @property
    def covariates(self) -> tuple[Covariate, ...]:
        """Covariates of the hazard model in model order."""
        no_yes = ("No", "Yes")
        age_name, age_bands = self.age_model
        levels = {
            "Gender_Label": self.gender_levels,
            "RaceCat": self.race_levels,
            age_name: age_bands.labels if self.name == "adult" else tuple(sorted(age_bands.labels)),
            "LOScat": tuple(sorted(self.los_cat.labels)),
            "FirstEpEver": ("N", "Y"),
            "MH_SA": ("MH", "SA"),
            "ASDID": ("ASD or ID", "No ASD or ID"),
            "Voluntary": ("Involuntary", "Voluntary"),
            "eligcat": tuple(sorted({*self.elig_cat.labels, self.elig_cat.null_label})),
        }
        names = (
            ["Gender_Label", "RaceCat", age_name, "LOScat", "FirstEpEver"] if self.name == "adult" else
            ["Gender_Label", "RaceCat", age_name, "ASDID", "MH_SA", "LOScat", "Flag_Active_DHS_Status",
             "Voluntary", "FirstEpEver"]
        )
        names += [f"After_{s}" for s in self.model_services]
        names += [f"Yr1Prior_{s}" for s in self.model_services]
        names += [*self.extra_model, "Yr1Prior_AnyAIP", "eligcat"]
        return tuple(Covariate(n, levels.get(n, no_yes)) for n in names)


# ---- fixed values -------------------------------------------------------------------------------

RACE_MAP = {
    "WHITE": "White",
    "BLACK OR AFRICAN AMERICAN": "Black",
    "HISPANIC": "Hispanic",
    "OTHER": "Other",
    "ASIAN": "Other",
    "N.AMER.INDIAN/ALASKAN NATIVE": "Other",
}

ELIG_DAY_BANDS = Bands((0, 99, 199, 299), ("ERROR", "1-99 Days", "100-199 Days", "200-299 Days", "300+ days"), "No Elig")
ELIG_YEAR_BANDS = Bands((182,), ("LT 50%", "50% +"), "No Elig")
WEEK_BANDS = Bands((7, 15, 21, 30), ("Week 1", "Week 2", "Week 3", "Week 4", "Month"))
MONTH_BANDS = Bands((30, 60, 90, 120, 150), ("Month 1", "Month 2", "Month 3", "Month 4", "Month 5", "Month 6"))

UNUSED_COLUMNS = ("Ep180", "Post_Discharge_RTF_Start", "Post_Discharge_Days_to_RTF", "Clinical_Category",
                  "HasServ_Before_Readmit")
CHILD_FLAGS = ("Flag_BHRS_18plus_Mths_Before_Admission", "Flag_Active_DHS_Status")

# Level of care (as delivered) -> short name used in column names.
ADULT_SERVICES = (
    ("23-Hour Bed", "23HrBed"), ("ACT", "ACT"), ("Acute Partial Adults", "AcutePartial"),
    ("BHSI Case Mgmt", "BHSICM"), ("CIRC", "CIRC"), ("IOP", "IOP"), ("Methadone", "MAT"),
    ("Outpatient", "OP"), ("Rehab", "Rehab"), ("Subacute", "Subacute"), ("TCM", "TCM"),
)
CHILD_SERVICES = (
    ("Acute Partial", "AcutePartial"), ("BHRS-CTSS", "BHRS_CTSS"), ("FB", "FBS"), ("Outpatient", "OP"),
    ("Rehab", "Rehab"), ("RTF", "RTF"), ("STS", "STS"), ("TCM", "TCM"),
)
# Short name -> text shown in hazard-ratio labels where it differs from the short name.
SHORT_DISPLAY = {"23HrBed": "23 Hr Bed", "BHSICM": "BHSI-CM", "AcutePartial": "Acute Partial",
                 "BHRS_CTSS": "BHRS/CTSS", "FBS": "FB", "AnyAIP": "AIP"}

LOC_LABELS = (("1-URGENT", "(100-1) ACUTE HOSPITAL SERVICES"), ("2-HIGH", "(100-4) INVOLUNTARY"))
BEFORE_MEASURES = ("Prior Service", "Additional Service", "Eligibility", "IP Discharges", "DHS")
AFTER_MEASURES = ("After Service", "IP Admissions")
MEASURES = BEFORE_MEASURES + AFTER_MEASURES
# Measures counted without a level of care.
MEASURES_WITHOUT_LOC = ("Eligibility", "DHS")

ADULT = RunSpec(
    name="adult",
    age_group="adult",
    period_begin=date(1998, 1, 1),
    period_end=date(2000, 12, 31),
    index_codes=("1-URGENT", "2-HIGH"),
    readmit_codes=("1-URGENT", "2-HIGH"),
    loc_labels=LOC_LABELS,
    voluntary_label="(100-1) ACUTE HOSPITAL SERVICES",
    min_los=1,
    min_readmit_days=2,
    quick_readmit_below=1,
    age_cat=Bands((25, 35, 45, 55), ("18 to 25", "26 to 35", "36 to 45", "46 to 55", "56+")),
    age_model=("AgeCat2", Bands((30, 40, 50), ("18 to 30", "31 to 40", "41 to 50", "51+"))),
    los_cat=Bands((3,), ("LT 5 days", "5+ days")),
    elig_cat=Bands((182,), ("Less than 50%", "50% +"), "No Elig"),
    elig_explore=Bands((181,), ("LT50%", "More than 50%"), "no elig"),
    service_groups=ADULT_SERVICES,
    additional_groups=(("EAC", "EAC"), ("JoH", "JoH"), ("RTFA", "RTFA")),
    drop_on_entry=UNUSED_COLUMNS + CHILD_FLAGS,
    extra_rules=(
        Rule("DHS line", (("BA_Category", ("Before",)), ("Measure_Name", ("DHS",)))),
        Rule("host home line",
             (("BA_Category", ("Before",)), ("Measure_Name", ("Additional Service",)),
              ("LOC", ("(450-1) HOST HOMES - DHS CHILD", "(450-2) HOST HOMES - NON-DHS CHILD")))),
    ),
    facets=("yearDC", "Flag_Readmit"),
    gender_levels=("Male", "Female"),
    race_levels=("White", "Black", "Hispanic", "Other"),
    model_services=("23HrBed", "BHSICM", "IOP", "MAT", "OP", "Rehab", "Subacute", "TCM"),
    km_strata=("LOScat", "AgeCat2"),
    wide_denominator="member_rows",
    term_display=(
        ("31 to 40", "31 to 40 (ref: 18-30yo)"), ("41 to 50", "41-50 (ref: 18-30yo)"), ("51+", "51+ (ref: 18-30yo)"),
        ("LT 5 days", "LOS Under 5 (ref: 5+)"),
        ("Less than 50%", "Yr1Prior: Elig < 50% of Yr (ref: 50+%)"), ("No Elig", "Yr1Prior: Elig 0 Days (ref: 50+%)"),
    ),
)

CHILD = RunSpec(
    name="child",
    age_group="child",
    period_begin=date(1998, 1, 1),
    period_end=date(2000, 12, 31),
    index_codes=("1-URGENT", "2-HIGH"),
    readmit_codes=("1-URGENT", "2-HIGH"),
    loc_labels=LOC_LABELS,
    voluntary_label="(100-1) ACUTE HOSPITAL SERVICES",
    min_los=1,
    min_readmit_days=1,
    quick_readmit_below=2,
    age_cat=Bands((10, 13), ("10 and under", "11 to 13", "14 to 17")),
    age_model=("Age14up", Bands((13,), ("Under 14", "14+"))),
    los_cat=Bands((10, 20, 30), ("10 and under", "11 - 20", "21-30", "31+")),
    elig_cat=Bands((182,), ("Less than 50%", "50% +"), "Less than 50%"),
    elig_explore=Bands((179,), ("LT50%", "More than 50%")),
    service_groups=CHILD_SERVICES,
    additional_groups=(("Host Homes", "HostHomes"), ("Stepping Stones", "SteppingStones")),
    drop_on_entry=UNUSED_COLUMNS,
    extra_rules=(),
    facets=("yearDC", "Flag_Readmit", "Flag_Active_DHS_Status"),
    gender_levels=("Male", "Female"),
    race_levels=("Black", "Hispanic", "Other", "White"),
    model_services=("AcutePartial", "BHRS_CTSS", "FBS", "OP", "Rehab", "RTF", "STS", "TCM"),
    km_strata=("LOScat", "Flag_Active_DHS_Status", "Age14up", "AgeCat", "ASDID"),
    wide_denominator="long_rows",
    additional_by_period=False,
    flags=CHILD_FLAGS,
    extra_model=("Yr1Prior_DHS",),
    prior_label="YrPrior",
    term_display=(
        ("Under 14", "Under 14 (ref: 14+)"), ("No ASD or ID", "No ASD/ID"), ("SA", "SA Hx"),
        ("11 - 20", "LOS 11-20 (ref: <= 10)"), ("21-30", "LOS 21-30 (ref: <= 10)"), ("31+", "LOS 31+ (ref: <= 10)"),
        ("Voluntary", "Voluntary Commitment"), ("Less than 50%", "Elig < 50% of Yr (ref: 50+%)"),
    ),
)

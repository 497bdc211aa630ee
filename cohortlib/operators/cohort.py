"""Building the cohort: index episodes, readmission, and days of use around the index episode.

Shape of the plan: all spans are one relation, shuffled once by member, and reduced to a few rows per member. The index table
has one row per member, so each join is many-to-one and cannot multiply rows. Index and episodes are staged tables,
so both sides of every such join come straight from an exchange: where one member owns a large part of a
relation, the adaptive skew join splits that partition, and the partial aggregation after it keeps the follow-up exchange small.

A stay or span without an end is still open: for every rule it ends at ``OPEN_END``.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortlib.functions.columns import map_values, overlap
from cohortlib.spec import AFTER_MEASURES, AUTH, MEASURES, MEASURES_WITHOUT_LOC, MEMBER, RunSpec

OPEN_END = "9999-12-31"

# One line of the long extract, before the member's attributes are attached.
LINE = ("struct<BA_Category:string,Measure_Name:string,Measure_Period:string,LOC:string,Day_Count:bigint>")


def far_end(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(OPEN_END).cast("date"))


def _line(ba: str, measure: str, period: str | None, loc: str, days: str) -> str:
    """SQL of one line; ``loc`` and ``days`` are SQL themselves. One text for all lines of a kind is parsed at once, where
    hundreds of Column objects would each take calls to the driver's JVM."""
    text = "NULL" if period is None else f"'{period}'"
    return (f"named_struct('BA_Category', '{ba}', 'Measure_Name', '{measure}', 'Measure_Period', CAST({text} AS STRING), "
            f"'LOC', CAST({loc} AS STRING), 'Day_Count', CAST({days} AS BIGINT))")


def _lines_with_days(lines: list[str]) -> str:
    return f"filter(array({', '.join(lines)}), x -> x.Day_Count > 0)"


def index_episodes(auth: DataFrame, spec: RunSpec) -> DataFrame:
    """Each member's first episode of the index levels of care with discharge inside the period.

    A minimum over a struct instead of a row number: it combines on the map side, so a member with
    very many authorizations never has to be sorted in one task. ``first_ever`` is Y when no episode
    of the index levels of care began before the chosen one.
    """
    in_period = F.col("se").between(F.lit(spec.period_begin), F.lit(spec.period_end))
    return (
        auth.where(F.col("code").isin(*spec.index_codes))
        .groupBy("member")
        .agg(F.min(F.when(in_period, F.struct("se", "auth", "sb", "code"))).alias("first"),
             F.min("sb").alias("earliest"))
        .where(F.col("first").isNotNull())
        .select("member", "first.auth", "first.sb", "first.se", "first.code",
                F.when(F.col("earliest") < F.col("first.sb"), "N").otherwise("Y").alias("first_ever")))


def _year_bounds(spec: RunSpec, year: int) -> tuple[Column, Column]:
    """Prior year ``year`` as a half-open span that ends ``year - 1`` years before admission."""
    return (F.date_sub("sb", spec.year_days * year), F.date_sub("sb", spec.year_days * (year - 1)))


def _lookback(spec: RunSpec) -> Column:
    return F.date_sub("sb", spec.year_days * spec.prior_years)


def episode_history(index: DataFrame, auth: DataFrame, spec: RunSpec) -> DataFrame:
    """One pass over the authorizations around each index episode.

    Readmission is the earliest other episode that begins within the follow-up days after discharge.
    Discharges are counted per prior year, admissions over the whole follow-up. All are
    aggregates of one interval join, so the authorizations are shuffled once.
    """
    keep = set(spec.index_codes) | set(spec.readmit_codes)
    last_day = F.date_add("se", spec.follow_up_days)
    other = auth.where(F.col("code").isin(*sorted(keep))).select(
        "member", F.col("auth").alias("o_auth"), F.col("sb").alias("o_sb"), far_end("se").alias("o_se"),
        F.col("code").alias("o_code"))
    near = (F.col("o_auth") != F.col("auth")) & (F.col("o_sb") <= last_day) & (F.col("o_se") >= _lookback(spec))
    follow_up = F.col("o_sb").between(F.col("se"), last_day)
    index_set = F.col("o_code").isin(*spec.index_codes)
    counts = []
    for y in spec.years:
        w_begin, w_end = _year_bounds(spec, y)
        counts.append(F.count_if(index_set & (F.col("o_se") >= w_begin) & (F.col("o_se") < w_end)).alias(f"n_dc_{y}"))
    readmit = F.min(F.when(follow_up & F.col("o_code").isin(*spec.readmit_codes), F.struct("o_sb", "o_auth")))
    aggs = [readmit.alias("readmit"), F.count_if(index_set & follow_up).alias("n_adm"), *counts]
    latest = F.date_add(F.lit(spec.period_end), spec.follow_up_days)          # static bound, reaches the scan of a staged table
    return other.where(F.col("o_sb") <= latest).join(index, "member").where(near).groupBy("member").agg(*aggs)


def find_readmission(index: DataFrame, auth: DataFrame, spec: RunSpec) -> DataFrame:
    """Index episodes with the readmission (null when there is none) and the days until it."""
    history = episode_history(index, auth, spec)
    return with_readmission(index.join(history.select("member", "readmit"), "member", "left"))


def with_readmission(joined: DataFrame) -> DataFrame:
    readmit_sb = F.col("readmit.o_sb")
    return joined.select(
        *[c for c in joined.columns if c != "readmit"],
        F.col("readmit.o_auth").alias("readmit_auth"), readmit_sb.alias("readmit_sb"),
        F.datediff(readmit_sb, "se").alias("days_to_readmit"))


def episodes(index: DataFrame, auth: DataFrame, spec: RunSpec) -> DataFrame:
    """Index episodes with readmission, event counts and the window after discharge."""
    joined = with_readmission(index.join(episode_history(index, auth, spec), "member", "left"))
    return after_window(joined, spec)


def after_window(index: DataFrame, spec: RunSpec) -> DataFrame:
    """[discharge, readmission) or [discharge, discharge + follow-up), whichever ends first."""
    return index.withColumns({
        "after_b": F.col("se"),
        "after_e": F.least("readmit_sb", F.date_add("se", spec.follow_up_days))})


def prior_windows(index: DataFrame, spec: RunSpec) -> DataFrame:
    """One row per member and year before admission."""
    bounds = [F.struct(F.lit(f"Year {y}").alias("Measure_Period"), _year_bounds(spec, y)[0].alias("w_b"),
                       _year_bounds(spec, y)[1].alias("w_e")) for y in spec.years]
    return index.select("member", F.inline(F.array(*bounds)))


def loc_grouping(services: DataFrame, loc_dim: DataFrame, age_group: str) -> DataFrame:
    """Attach the level of care of the age group; null for codes outside every group."""
    return services.join(loc_dim.where(F.col("age_group") == age_group).select("code", "LOC"), "code", "left")


def _near_spans(index: DataFrame, spans: DataFrame, spec: RunSpec, after: bool) -> DataFrame:
    """Spans joined to their member's index episode and limited to the studied time."""
    last_day = F.col("after_e") if after else F.col("sb")
    cols = ["member", "sb"] + (["after_b", "after_e"] if after else [])
    latest = F.date_add(F.lit(spec.period_end), spec.follow_up_days)   # both bounds reach the scan
    earliest = index.agg(F.date_sub(F.min("sb"), spec.year_days * spec.prior_years)).scalar()
    inside = (F.col("b") < last_day) & (F.col("e") > _lookback(spec))
    near = spans.where((F.col("b") < latest) & (F.col("e").isNull() | (F.col("e") > earliest))).withColumn("e", far_end("e"))
    return near.join(index.select(*cols), "member").where(inside)


def _year_overlaps(spec: RunSpec) -> dict[str, Column]:
    return {f"y{y}": F.sum(overlap(F.col("b"), F.col("e"), *_year_bounds(spec, y))) for y in spec.years}


def service_days(index: DataFrame, services: DataFrame, loc_dim: DataFrame, spec: RunSpec) -> DataFrame:
    """Days per member, level of care and service line in the window after discharge (``after``) and
    in each prior year (``y1`` ...). All windows come out of one join and one aggregation."""
    after = F.sum(overlap(F.col("b"), F.col("e"), F.col("after_b"), F.col("after_e")))
    aggs = [c.alias(n) for n, c in {"after": after, **_year_overlaps(spec)}.items()]
    days = _near_spans(index, services, spec, True).groupBy("member", "code", "sub").agg(*aggs)
    return (loc_grouping(days, loc_dim, spec.age_group).groupBy("member", "LOC", "sub")
            .agg(*[F.sum(c).alias(c) for c in days.columns[3:]]))


def overlap_days(spans: DataFrame, index: DataFrame, spec: RunSpec, keys: tuple[str, ...] = ()) -> DataFrame:
    """Days of the spans inside each prior year; overlapping spans count each."""
    aggs = [c.alias(n) for n, c in _year_overlaps(spec).items()]
    return _near_spans(index, spans, spec, False).groupBy("member", *keys).agg(*aggs)


def merge_spans(spans: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Union of overlapping or touching spans per key.

    Spans with equal begin are first reduced to the longest, which combines on the map side and
    leaves at most one row per key and calendar day for the window that finds the islands.
    ``carry`` columns must be constant within a key. A union that is still open has no end.
    """
    first = [F.first(c).alias(c) for c in carry]
    spans = spans.withColumn("e", far_end("e"))
    longest = spans.where(F.col("e") > F.col("b")).groupBy(*keys, "b").agg(F.max("e").alias("e"), *first)
    by_begin = W.partitionBy(*keys).orderBy("b")
    reach = F.max("e").over(by_begin.rowsBetween(W.unboundedPreceding, -1))
    return (longest.withColumn("starts", F.when(reach >= F.col("b"), 0).otherwise(1))
            .withColumn("island", F.sum("starts").over(by_begin))
            .groupBy(*keys, "island").agg(F.min("b").alias("b"), F.nullif(F.max("e"), F.lit(OPEN_END).cast("date")).alias("e"), *first)
            .drop("island"))


def covered_days(index: DataFrame, spans: DataFrame, spec: RunSpec) -> DataFrame:
    """Distinct calendar days covered by the spans in each prior year (a day counts once)."""
    aggs = [c.alias(n) for n, c in _year_overlaps(spec).items()]

    clipped = _near_spans(index, spans, spec, False).select(
        "member", "sb", F.greatest("b", _lookback(spec)).alias("b"), F.least("e", "sb").alias("e"))
    return merge_spans(clipped, ("member",), carry=("sb",)).groupBy("member").agg(*aggs)


def active_on(spans: DataFrame, index: DataFrame) -> DataFrame:
    """1 when a span holds the day of admission."""
    inside = F.max(F.when((F.col("b") <= F.col("sb")) & (far_end("e") > F.col("sb")), 1).otherwise(0)).alias("active")
    return spans.join(index.select("member", "sb"), "member").groupBy("member").agg(inside)


def lasted_months(spans: DataFrame, index: DataFrame, months: int) -> DataFrame:
    """1 when a span reached ``months`` months by the day of admission."""
    reached = F.max(F.when(F.add_months("b", months) <= F.least("e", "sb"), 1).otherwise(0)).alias("lasted")
    return (spans.join(index.select("member", "sb"), "member").where(F.col("b") < F.col("sb"))
            .groupBy("member").agg(reached))


# Kinds of spans; of the second group each calendar day counts once, however many spans cover it.
KINDS = ("service", "additional", "eligibility", "dhs", "bhrs")
DAYS_ONCE = ("eligibility", "dhs")
BHRS_MONTHS = 18


def tagged_spans(inputs, earliest: date, latest: date) -> DataFrame:
    """All spans as one relation: member, kind, b, e (an open span ends at ``OPEN_END``), code, sub; without those that ended
    by ``earliest`` or begin at ``latest`` or later. How long a BHRS span lasted counts whenever it was."""
    def tagged(spans: DataFrame, kind: str, code: str | None = None, sub: str | None = None) -> DataFrame:
        text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
        near = spans.where(F.col("b") < F.lit(latest))
        if kind != "bhrs":
            near = near.where(F.col("e").isNull() | (F.col("e") > F.lit(earliest)))
        return near.select("member", F.lit(kind).alias("kind"), "b", far_end("e").alias("e"), text(code).alias("code"), text(sub).alias("sub"))

    parts = [tagged(inputs.services, "service", "code", "sub"), tagged(inputs.additional, "additional", "LOC"),
             *(tagged(getattr(inputs, kind), kind) for kind in ("eligibility", "dhs", "bhrs"))]
    return reduce(DataFrame.unionByName, parts)


def span_days(eps: DataFrame, spans: DataFrame, loc_dim: DataFrame, spec: RunSpec) -> DataFrame:
    """member, kind, LOC, sub with the days in the window after discharge (``after``, services) and in each prior year (``y1`` ...),
    whether a span holds the day of admission (``active``, DHS) and whether one lasted 18 months by then (``lasted``, BHRS).

    One exchange of the spans, by member; everything after it keeps that partitioning. Spans are added up per code, or
    per begin where days count once: of the latter at most one row per member and day is left. In the order of their begins
    each of these counts from the furthest end before it, so the days of overlapping spans are counted once without
    forming their unions. The level of care is attached to sums, not to spans."""
    kind = F.col("kind")
    once = kind.isin(*DAYS_ONCE)
    met = spans.join(eps.select("member", "sb", "after_b", "after_e").hint("merge"), "member")
    until = F.when(kind == "service", F.col("b") < F.col("after_e")).when(kind == "dhs", F.col("b") <= F.col("sb")).otherwise(F.col("b") < F.col("sb"))
    met = met.where(until & ((kind == "bhrs") | (F.col("e") > _lookback(spec))))
    windows = {f"y{y}": _year_bounds(spec, y) for y in spec.years}
    sums = {"after": F.sum(F.when(kind == "service", overlap(F.col("b"), F.col("e"), F.col("after_b"), F.col("after_e")))),
            **{n: F.sum(F.when(kind.isin("service", "additional"), overlap(F.col("b"), F.col("e"), *w))) for n, w in windows.items()}}
    reached = (kind == "bhrs") & (F.add_months("b", BHRS_MONTHS) <= F.least("e", "sb"))
    flags = {"active": F.max(F.when((kind == "dhs") & (F.col("e") > F.col("sb")), 1).otherwise(0)), "lasted": F.max(F.when(reached, 1).otherwise(0))}
    few = met.groupBy("member", "kind", "code", "sub", F.when(once, F.greatest("b", _lookback(spec))).alias("day")).agg(
        F.max("sb").alias("sb"), F.max(F.when(once, F.least("e", "sb"))).alias("till"), *(c.alias(n) for n, c in (sums | flags).items()))
    earlier = W.partitionBy("member", "kind").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    own = few.withColumn("day", F.greatest("day", F.max("till").over(earlier)))
    own = own.withColumns({n: F.when(once, overlap(F.col("day"), F.col("till"), *w)).otherwise(F.col(n)) for n, w in windows.items()})
    dim = loc_dim.where(F.col("age_group") == spec.age_group).select("code", F.col("LOC").alias("group"))
    loc = F.when(kind == "service", F.col("group")).when(kind == "additional", F.col("code"))
    total = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in sums]
    return (own.join(F.broadcast(dim), "code", "left").withColumn("LOC", loc)
            .groupBy("member", "kind", "LOC", "sub").agg(*total, *(F.max(n).alias(n) for n in flags)))


def _year_lines(spec: RunSpec, measure: str, loc: str) -> list[str]:
    return [_line("Before", measure, f"Year {y}", loc, f"y{y}") for y in spec.years]


def _blank(measure: str) -> str:
    """The placeholder line, if ``found`` has no grouped line of the measure; else null."""
    grouped = "" if measure in MEASURES_WITHOUT_LOC else " AND x.LOC IS NOT NULL"
    line = _line("After" if measure in AFTER_MEASURES else "Before", measure, None, "NULL", "0")
    return f"CASE WHEN NOT exists(found, x -> x.Measure_Name = '{measure}'{grouped}) THEN {line} END"


def measure_lines(eps: DataFrame, days: DataFrame, spec: RunSpec) -> DataFrame:
    """All measure lines of each member as one array column, with a placeholder line (no period, no
    level of care, zero days) for every measure the member has no grouped line in; and the two flags of ``days``.

    The arrays are bounded by levels of care x lines x periods. DHS involvement is delivered for every age group; the adult
    cleaning rules remove it again."""
    lines = {"service": [_line("After", "After Service", spec.after_period, "LOC", "after"), *_year_lines(spec, "Prior Service", "LOC")],
             "additional": _year_lines(spec, "Additional Service", "LOC"), "eligibility": _year_lines(spec, "Eligibility", "NULL"),
             "dhs": _year_lines(spec, "DHS", "NULL")}
    of_kind = " ".join(f"WHEN '{kind}' THEN {_lines_with_days(x)}" for kind, x in lines.items())
    per_member = days.groupBy("member").agg(F.expr(f"flatten(collect_list(CASE kind {of_kind} END)) AS found"),
                                            F.max("lasted").alias("lasted"), F.max("active").alias("active"))
    ip = [_line("After", "IP Admissions", spec.after_period, "'IP'", "n_adm"), *(_line("Before", "IP Discharges", f"Year {y}", "'IP'", f"n_dc_{y}") for y in spec.years)]
    empty = f"CAST(array() AS ARRAY<{LINE}>)"
    found = f"concat(coalesce(found, {empty}), coalesce({_lines_with_days(ip)}, {empty})) AS found"
    out = eps.join(per_member, "member", "left").selectExpr(*eps.columns, found, "coalesce(lasted, 0) AS lasted", "coalesce(active, 0) AS active")
    blanks = f"filter(array({', '.join(map(_blank, MEASURES))}), x -> x IS NOT NULL)"
    return out.selectExpr(*eps.columns, "lasted", "active", f"concat(found, {blanks}) AS lines")


def admission_flags(eps: DataFrame, inputs) -> DataFrame:
    """DHS involvement on the day of admission, and a BHRS episode of 18 months by then (0/1)."""
    return (eps.select("member")
            .join(lasted_months(inputs.bhrs, eps, BHRS_MONTHS), "member", "left")
            .join(active_on(inputs.dhs, eps), "member", "left")
            .select("member", F.coalesce("lasted", F.lit(0)).alias("lasted"),
                    F.coalesce("active", F.lit(0)).alias("active")))


def to_extract(eps: DataFrame, days: DataFrame, members: DataFrame, spec: RunSpec) -> DataFrame:
    """The long extract: one line per index episode, measure, period and level of care. ``days`` is the result of ``span_days``."""
    wide = measure_lines(eps, days, spec).join(members, "member", "left")
    none = F.lit(None).cast("string")
    return wide.select(
        F.col("auth").alias(AUTH), F.col("member").alias(MEMBER),
        F.col("sb").alias("ServiceBegin"), F.col("se").alias("ServiceEnd"),
        "Gender_Label", "RaceEthnic_Label", "Age", "ASD_Measure_Year", "ID_Measure_Year",
        map_values("code", dict(spec.loc_labels)).alias("LOC_Label"), F.col("first_ever").alias("FirstEpEver"), "MH_SA",
        F.coalesce("readmit_auth", F.lit(0)).alias("Readmit_Auth"), F.col("readmit_sb").alias("Readmit_SB"),
        F.col("days_to_readmit").alias("Days_to_Readmit"),
        F.col("lasted").alias("Flag_BHRS_18plus_Mths_Before_Admission"), F.col("active").alias("Flag_Active_DHS_Status"),
        none.alias("Ep180"), none.alias("Post_Discharge_RTF_Start"), none.alias("Post_Discharge_Days_to_RTF"),
        none.alias("Clinical_Category"), none.alias("HasServ_Before_Readmit"),
        F.inline("lines"))


def as_delivered(extract: DataFrame) -> DataFrame:
    """The extract in its file form: month/day/year dates, the text NA for missing service fields."""
    mdy = lambda c: F.date_format(c, "MM/dd/yyyy")
    na = lambda c: F.coalesce(c, F.lit("NA"))
    return extract.withColumns({
        "ServiceBegin": mdy("ServiceBegin"), "ServiceEnd": mdy("ServiceEnd"), "Readmit_SB": na(mdy("Readmit_SB")),
        "Measure_Period": na(F.col("Measure_Period")), "LOC": na(F.col("LOC"))})

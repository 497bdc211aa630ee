"""Kaplan-Meier curves, log-rank tests and hazard-ratio tables.

Follow-up time is a whole number of days, so every estimate starts from counts per stratum and day;
windows and small solves then run over at most (follow-up days x strata) rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortlib.functions import if_known
from cohortlib.spec import SHORT_DISPLAY, RunSpec

Z95 = 1.959963984540054  # 97.5% point of the standard normal


def surv(df: DataFrame, time: str, event: str) -> DataFrame:
    """Right-censored pairs: rows with a missing time or event are left out, other events than 0/1
    or negative times fail the job."""
    ok = F.col(event).isin(0, 1) & (F.col(time) >= 0)
    checked = F.when(ok, F.col(event)).otherwise(F.raise_error(F.lit("event must be 0 or 1 and time not negative")))
    return df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).withColumn(event, checked.cast("int"))


def risk_table(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Events, censorings and members at risk per stratum and time. Missing strata are left out."""
    known = surv(df, time, event).dropna(subset=list(by)) if by else surv(df, time, event)
    counts = known.groupBy(*by, F.col(time).alias("time")).agg(
        F.sum(event).alias("n_event"), F.count_if(F.col(event) == 0).alias("n_censor"))
    from_here = W.partitionBy(*by).orderBy(F.desc("time"))
    return counts.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(from_here))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Survival curve at event times with Greenwood's standard error and 95% limits on the log scale.

    Where survival reaches zero the limits are undefined and therefore null."""
    up_to = W.partitionBy(*by).orderBy("time")
    d, n = F.col("n_event"), F.col("n_risk")
    curve = (risk_table(df, time, event, by)
             .withColumn("survival", F.product((n - d) / n).over(up_to))
             .withColumn("hazard_var", F.sum(F.try_divide(d, n * (n - d))).over(up_to))
             .where(d > 0))
    s, se = F.col("survival"), F.sqrt("hazard_var")
    alive = lambda c: F.when(s > 0, c)
    return curve.select(
        *by, "time", "n_risk", "n_event", "n_censor", "survival",
        alive(s * se).alias("std_err"),
        alive(s * F.exp(-Z95 * se)).alias("conf_low"),
        alive(F.least(F.lit(1.0), s * F.exp(Z95 * se))).alias("conf_high"))


def km_median(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First time survival is at or below one half; null when it never is."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"))


def survival_at(curve: DataFrame, at: int, by: Sequence[str] = ()) -> DataFrame:
    """Survival of each stratum at a given time (1 before the first event)."""
    return curve.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("time") <= at, F.col("survival"))), F.lit(1.0)).alias("survival"))


def logrank_table(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Members, observed and expected events and the variance of their difference per group.

    The counts are laid on the grid of event times and groups, whose size is bounded by follow-up
    days x groups; a group's members at risk between its own times are carried from the next one."""
    counts = risk_table(df, time, event, [by]).select(by, "time", "n_event", "n_censor")
    totals = counts.groupBy("time").agg(F.sum("n_event").alias("d"), F.sum(F.col("n_event") + F.col("n_censor")).alias("leave"))
    totals = totals.withColumn("n", F.sum("leave").over(W.partitionBy().orderBy(F.desc("time"))))
    sizes = counts.groupBy(by).agg(F.sum(F.col("n_event") + F.col("n_censor")).alias("size"), F.sum("n_event").alias("observed"))
    own = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(
        F.struct("time", (F.col("n_event") + F.col("n_censor")).alias("leave")))).alias("leaves"))
    # Per group: the sorted pooled times with their totals, one array of at most follow-up-days entries.
    pooled = totals.agg(F.array_sort(F.collect_list(F.struct("time", "d", "n"))).alias("grid")).scalar()
    grid = own.join(sizes, by).select(by, "size", "observed", "leaves", F.inline(pooled))
    gone = F.coalesce(F.col("leaves")[F.col("time")], F.lit(0))
    before = W.partitionBy(by).orderBy("time").rowsBetween(W.unboundedPreceding, -1)
    at_risk = F.col("size") - F.coalesce(F.sum(gone).over(before), F.lit(0))
    d, n, r = F.col("d"), F.col("n"), F.col("r")
    share = r / n
    return (grid.withColumn("r", at_risk).groupBy(by, "size", "observed").agg(
        F.sum(d * share).alias("expected"),
        F.sum(F.coalesce(F.try_divide(d * share * (1 - share) * (n - d), n - 1), F.lit(0.0))).alias("variance"))
        .withColumnRenamed("size", "n"))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution (regularised incomplete gamma function)."""
    if dof <= 0 or not x > 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    frac = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        frac *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * frac


def logrank(df: DataFrame, time: str, event: str, by: str) -> DataFrame:
    """Log-rank test over two or more groups: one row per group with the joint statistic.

    The risk table (at most follow-up days x groups rows) comes to the driver for the solve of the
    (groups - 1) square system."""
    rows = risk_table(df, time, event, [by]).select(by, "time", "n_event", "n_censor").collect()
    groups = sorted({r[by] for r in rows})
    times = sorted({r["time"] for r in rows})
    d = np.zeros((len(times), len(groups)))
    leave = np.zeros_like(d)
    for r in rows:
        t, g = times.index(r["time"]), groups.index(r[by])
        d[t, g] = r["n_event"]
        leave[t, g] = r["n_event"] + r["n_censor"]
    at_risk = leave[::-1].cumsum(axis=0)[::-1]
    n, dd = at_risk.sum(axis=1), d.sum(axis=1)
    share = at_risk / n[:, None]
    observed, expected = d.sum(axis=0), (dd[:, None] * share).sum(axis=0)
    factor = np.where(n > 1, dd * (n - dd) / np.maximum(n - 1, 1), 0.0)
    var = np.diag((factor[:, None] * share).sum(axis=0)) - (share * factor[:, None]).T @ share
    k = len(groups) - 1
    diff = (observed - expected)[:k]
    chisq = float(diff @ np.linalg.pinv(var[:k, :k]) @ diff) if k else 0.0
    out = [(str(g), int(leave[:, i].sum()), int(observed[i]), float(expected[i]), float(var[i, i]), chisq, k, chi2_tail(chisq, k))
           for i, g in enumerate(groups)]
    return df.sparkSession.createDataFrame(
        out, f"`{by}` string, n long, observed long, expected double, variance double, chisq double, df int, p_value double")


# ---- hazard-ratio table ---------------------------------------------------------------------------

def hazard_ratio_columns(tidy: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Hazard ratio with limits, significance and direction of the effect per model term."""
    df = tidy.withColumns({
        "HR": F.exp("estimate"), "HRconf_low": F.exp("conf_low"), "HRconf_high": F.exp("conf_high"),
        "sig": if_known(F.col("p_value") <= alpha, "Yes", "No")})
    impact: Column = F.when(F.col("sig") == "No", "No Impact").when(
        F.col("sig") == "Yes", F.when(F.col("HR") < 1, "Decreases Risk").otherwise("Increases Risk"))
    return df.withColumn("RiskImpact", impact)


def term_labels(spec: RunSpec) -> dict[str, str]:
    """Display label per model term, made from the covariates and their declared levels."""
    shown = dict(spec.term_display)
    labels = {}
    for cov in spec.covariates:
        for level in cov.levels[1:]:
            term = f"{cov.name}{level}"
            if cov.name == "Yr1Prior_AnyAIP":
                text = "Yr1Prior: AIP"
            elif cov.name.startswith("After_"):
                short = cov.name.removeprefix("After_")
                text = f"FUP: {SHORT_DISPLAY.get(short, short)}"
            elif cov.name.startswith("Yr1Prior_"):
                short = cov.name.removeprefix("Yr1Prior_")
                text = f"{spec.prior_label}: {SHORT_DISPLAY.get(short, short)}"
            elif cov.name == "RaceCat":
                text = f"{level} (ref: {cov.levels[0]})"
            elif cov.name == "FirstEpEver":
                text = f"First {spec.index_loc} Ever"
            elif cov.name == "Flag_Active_DHS_Status":
                text = f"DHS during {spec.index_loc}"
            elif cov.name == "Gender_Label":
                text = level
            else:
                text = shown.get(level, "ERROR")
            labels[term] = text
    return labels


def label_terms(tidy: DataFrame, mapping: Mapping[str, str], default: str = "ERROR") -> DataFrame:
    """Attach display labels; terms without one get ``default`` so that they stand out."""
    names = tidy.sparkSession.createDataFrame(list(mapping.items()), "term string, factors string")
    return tidy.join(names, "term", "left").withColumn("factors", F.coalesce("factors", F.lit(default)))


def unlabelled_terms(labelled: DataFrame, default: str = "ERROR") -> DataFrame:
    return labelled.where(F.col("factors") == default).select("term", "factors").distinct()


def significant(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("sig") == "Yes")

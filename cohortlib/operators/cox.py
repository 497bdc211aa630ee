"""Cox proportional-hazards model, fitted on Spark, with the three usual treatments of tied event times.

Covariates are categories and time is whole days, so member rows are first counted per distinct
(covariates, time, event) pattern; the 0/1 covariates of a pattern are the bits of whole numbers. A Newton step is then two
grouped sums over the patterns, of built-in functions:

1. per day, the weighted sums of the members and of the events, p + 1 numbers each; from these few
   rows the driver gets the risk-set sums;
2. the weighted cross products of the covariates, where each pattern's weight already holds its
   share of all later risk sets: one row for each covariate.

Neither pass collects rows: the driver sees (days x p) and (p x p) numbers only. Where (days x p x p) numbers are few, one pass
gives the cross products per day, and the driver makes the information matrix of these. Coefficients and shares of days come
as the value of a scalar subquery, so the generated code is the same in every step and is compiled once.

The exact likelihood of tied events (``ties="exact"``) has its own pass, see ``_exact_pass``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlib.operators.survival import Z95, chi2_tail, surv
from cohortlib.session import durable
from cohortlib.spec import Covariate


@dataclass
class CoxFit:
    terms: list[str]
    beta: np.ndarray                  # NaN for a term that the others determine
    se: np.ndarray
    loglik_null: float
    loglik: float
    score_test: float
    wald_test: float
    n: int
    n_events: int
    n_left_out: int                   # rows with a missing covariate, time or event
    iterations: int
    converged: bool
    time: str
    event: str
    covariates: list[Covariate]
    patterns: DataFrame = field(repr=False)

    @property
    def used(self) -> np.ndarray:
        return ~np.isnan(self.beta)

    @property
    def dof(self) -> int:
        return int(self.used.sum())


def design_matrix(df: DataFrame, covariates: Sequence[Covariate], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Treatment coding: one 0/1 column per level after the first, named variable + level. Rows with
    a missing covariate are left out; levels that are not declared must be found beforehand (``undeclared_levels``)."""
    known = df
    terms, cols = [], []
    for cov in covariates:
        known = known.where(F.col(cov.name).isin(*cov.levels))
        for level in cov.levels[1:]:
            terms.append(f"{cov.name}{level}")
            cols.append((F.col(cov.name) == level).cast("int").alias(f"x{len(terms) - 1}"))
    return known.select(*keep, *cols), terms


def undeclared_levels(df: DataFrame, covariates: Sequence[Covariate]) -> DataFrame:
    """variable, level, n of values that no declared level covers; one pass over the rows."""
    found = [F.struct(F.lit(c.name).alias("variable"), F.col(c.name).cast("string").alias("level"),
                      (F.col(c.name).isNotNull() & ~F.col(c.name).isin(*c.levels)).alias("odd")) for c in covariates]
    return df.select(F.inline(F.array(*found))).where("odd").groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


# Covariates held in one whole number.
BITS = 62


def bit(i: int) -> str:
    """SQL of covariate ``i`` of a pattern, 0 or 1. The passes are written as text: a few terms make hundreds of expressions,
    which as Column objects take a call to the driver's JVM each."""
    return f"(shiftright(m{i // BITS}, {i % BITS}) & 1L)"


def _sum_of_bits(value: str, name: str, p: int) -> list[Column]:
    """Sums of ``value`` over the rows that have each covariate."""
    return [F.expr(f"sum({value} * {bit(i)}) AS {name}{i}") for i in range(p)]


def _masks(p: int) -> list[str]:
    return [f"m{j}" for j in range(-(-p // BITS))]


def _patterns(df: DataFrame, time: str, event: str, covariates: Sequence[Covariate],
              keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    design, terms = design_matrix(surv(df, time, event), covariates, (time, event))
    masks = []
    for j, name in enumerate(_masks(len(terms))):
        held = [F.shiftleft(F.col(f"x{i}").cast("bigint"), i % BITS) for i in range(j * BITS, min(len(terms), (j + 1) * BITS))]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), held).alias(name))
    packed = design.select(F.col(time).cast("int").alias("t"), F.col(event).alias("e"), *masks)
    return keep(packed.groupBy(*packed.columns).agg(F.count(F.lit(1)).alias("k"))), terms


def _constants(spark: SparkSession, **arrays: np.ndarray) -> Column:
    """Arrays as the fields of one scalar subquery's value."""
    fields = [F.lit([float(v) for v in values]).cast("array<double>").alias(name) for name, values in arrays.items()]
    return spark.range(0, 1, 1, 1).select(F.struct(*fields).alias("c")).scalar()


def _weighted(patterns: DataFrame, beta: np.ndarray, share: str = "1", **arrays: np.ndarray) -> DataFrame:
    """The patterns with ``w``, their members times their relative risk, and times ``share``: SQL that may use ``arrays`` as fields of c."""
    p = len(beta)
    c = _constants(patterns.sparkSession, b=np.where(beta == beta, beta, 0.0), **arrays)
    score = " + ".join(["0.0D", *(f"c.b[{i}] * {bit(i)}" for i in range(p))])
    return patterns.select("t", "e", "k", *_masks(p), c.alias("c")).selectExpr("t", "e", *_masks(p), f"k * exp({score}) * {share} AS w", "k")


@dataclass
class _Events:
    """Constants of the fit: the days with rows, and per day the events and their covariate sums."""

    days: np.ndarray
    d: np.ndarray
    dx: np.ndarray


def _events(patterns: DataFrame, p: int) -> _Events:
    rows = patterns.groupBy("t").agg(F.sum(F.col("k") * F.col("e")).alias("d"), *_sum_of_bits("k * e", "d", p)).collect()  # one per day
    rows.sort(key=lambda r: r["t"])
    return _Events(np.array([r["t"] for r in rows]), np.array([r["d"] for r in rows], dtype=float),
                   np.array([[r[f"d{i}"] for i in range(p)] for r in rows], dtype=float).reshape(len(rows), p))


@dataclass
class _Sums:
    """Per event day: what the partial likelihood needs, plus the weights of the second pass."""

    loglik: float
    score: np.ndarray
    mean_outer: np.ndarray     # or the information itself, where no second pass is needed
    share_all: np.ndarray      # sum over ties of 1 / denominator
    share_tied: np.ndarray     # sum over ties of (l / d) / denominator


def _tie_terms(f: np.ndarray, den: np.ndarray) -> np.ndarray:
    return np.stack([np.log(den), 1 / den, f / den, 1 / den**2, f / den**2, f**2 / den**2])


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _tie_sums(d: int, risk: float, tied: float, exact: int = 4096) -> np.ndarray:
    """Sums over the d tied events of a day, with f = l/d and D = risk - f * tied, l = 0 .. d-1:
    log D, 1/D, f/D, 1/D^2, f/D^2, f^2/D^2.

    Up to ``exact`` events are added up one by one. Of more, the last ``exact`` / 2 are (there D may come close to
    0), and the sum over the first n is the midpoint rule read backwards: the integral over l from -1/2 to n - 1/2, less
    a 24th of the difference of slopes at its ends. What that leaves out is below 1e-12 of the sum, as D changes by less
    than 1/2000 of itself from one event to the next. The integral runs over log D in panels of at most 1, which a
    20-point Gauss rule fits to rounding. So the work for a day does not grow with its events."""
    if d <= exact:
        f = np.arange(d) / d
        return _tie_terms(f, risk - f * tied).sum(axis=1)
    n = d - exact // 2
    f = np.arange(n, d) / d
    total = _tie_terms(f, risk - f * tied).sum(axis=1)
    high, low = risk + 0.5 * tied / d, risk - (n - 0.5) / d * tied
    panels = max(1, math.ceil(math.log(high / low)))
    edges = np.linspace(0.0, math.log(high / low), panels + 1)
    for a, b in zip(edges, edges[1:], strict=False):
        s = (a + b) / 2 + (b - a) / 2 * _NODES
        den = high * np.exp(-s)
        f = (-0.5 - d * high * np.expm1(-s) / tied) / d
        total += (_tie_terms(f, den) * den * _WEIGHTS).sum(axis=1) * (b - a) / 2 * d / tied
    ends = _tie_terms(np.array([-1, 0, n - 1, n]) / d, risk - np.array([-1, 0, n - 1, n]) / d * tied)
    return total - ((ends[:, 3] - ends[:, 2]) - (ends[:, 1] - ends[:, 0])) / 24


def _same_risk(d: int, risk: float, tied: float) -> np.ndarray:
    """As ``_tie_sums`` where all tied events meet the whole risk set."""
    return np.array([d * math.log(risk), d / risk, 0.0, d / risk**2, 0.0, 0.0])


def _first_pass(patterns: DataFrame, beta: np.ndarray, events: _Events, tie_sums: Callable[[int, float, float], np.ndarray]) -> _Sums:
    """Weighted sums per day and event status."""
    p, days = len(beta), events.days
    coef = np.where(beta == beta, beta, 0.0)
    sums = [F.sum("w").alias("s"), *_sum_of_bits("w", "s", p)]
    total = np.zeros((2 * len(days), p + 1))
    for r in _weighted(patterns, beta).groupBy("t", "e").agg(*sums).collect():           # <= 2 x days rows of p + 1 numbers
        total[2 * np.searchsorted(days, r["t"]) + r["e"]] = r[2:]
    tied = total[1::2]
    risk = (total[0::2] + tied)[::-1].cumsum(axis=0)[::-1]
    loglik = 0.0
    score = np.zeros(p)
    outer = np.zeros((p, p))
    share_all, share_tied = np.zeros(len(days)), np.zeros(len(days))
    for i in np.nonzero(events.d)[0]:
        logs, u0, u1, v0, v1, v2 = tie_sums(int(events.d[i]), risk[i, 0], tied[i, 0])
        r, t = risk[i, 1:], tied[i, 1:]
        loglik += float(events.dx[i] @ coef) - float(logs)
        score += events.dx[i] - (u0 * r - u1 * t)
        outer += v0 * np.outer(r, r) - v1 * (np.outer(r, t) + np.outer(t, r)) + v2 * np.outer(t, t)
        share_all[i], share_tied[i] = u0, u1
    return _Sums(loglik, score, outer, share_all, share_tied)


def _one_pass(patterns: DataFrame, beta: np.ndarray, events: _Events, tie_sums: Callable[[int, float, float], np.ndarray]) -> _Sums:
    """Both passes in one: weighted cross products per day and event status, of the covariates and a constant one, whose row
    holds the plain sums."""
    p, days = len(beta), events.days
    coef = np.where(beta == beta, beta, 0.0)
    terms = ["1L", *map(bit, range(p))]
    held = _weighted(patterns, beta).selectExpr("t", "e", "w", *_masks(p), f"posexplode(array({', '.join(terms)})) AS (i, held)").where("held = 1")
    cross = np.zeros((len(days), 2, p + 1, p + 1))
    for r in held.groupBy("t", "e", "i").agg(F.sum("w").alias("s"), *_sum_of_bits("w", "s", p)).collect():    # <= 2 x days x p rows
        cross[np.searchsorted(days, r["t"]), r["e"], r["i"]] = r[3:]
    tied = cross[:, 1]
    risk = cross.sum(axis=1)[::-1].cumsum(axis=0)[::-1]
    loglik, score, info = 0.0, np.zeros(p), np.zeros((p, p))
    for i in np.nonzero(events.d)[0]:
        logs, u0, u1, v0, v1, v2 = tie_sums(int(events.d[i]), risk[i, 0, 0], tied[i, 0, 0])
        r, t = risk[i, 0, 1:], tied[i, 0, 1:]
        loglik += float(events.dx[i] @ coef) - float(logs)
        score += events.dx[i] - (u0 * r - u1 * t)
        info += u0 * risk[i, 1:, 1:] - u1 * tied[i, 1:, 1:] - (v0 * np.outer(r, r) - v1 * (np.outer(r, t) + np.outer(t, r)) + v2 * np.outer(t, t))
    return _Sums(loglik, score, info, np.zeros(0), np.zeros(0))


# Most numbers that the driver gets per step.
CROSS_NUMBERS = 1 << 22


def _second_pass(patterns: DataFrame, beta: np.ndarray, events: _Events, sums: _Sums) -> np.ndarray:
    """Information matrix. A member counts for every event day up to its own time; a tied event
    gives back the part Efron's correction takes off on its day."""
    p = len(beta)
    if not p:
        return np.zeros((0, 0))
    first, span = int(events.days[0]), int(events.days[-1] - events.days[0]) + 1         # arrays over all days of the follow-up
    upto, tied = np.zeros(span), np.zeros(span)
    upto[events.days - first], tied[events.days - first] = np.cumsum(sums.share_all), sums.share_tied
    shared = _weighted(patterns, beta, f"(c.upto[t - {first}] - e * c.tied[t - {first}])", upto=upto, tied=tied)
    per_term = shared.selectExpr(f"posexplode(array({', '.join(map(bit, range(p)))})) AS (i, held)", *_masks(p), "w").where("held = 1")
    info = np.zeros((p, p))
    for r in per_term.groupBy("i").agg(*_sum_of_bits("w", "s", p)).collect():      # p rows of p numbers
        info[r["i"]] = r[1:]
    return info - sums.mean_outer


# ---- the exact likelihood: the events of a day are any of the sets of that size among the members at risk

# More events in a day than these, with nobody left over at risk on any event day, are an error.
EXACT_EVENTS = 400
# Most complex numbers that a task adds up in one go; the days are dealt over as many goes as that takes.
EXACT_NUMBERS = 1 << 22
# What is left out of a sum is below exp(-EXACT_TAIL) of it.
EXACT_TAIL = 50.0
# Width of a class of relative risks, in which the tilt of a day is found.
RISK_CLASS = 1 / 64


@dataclass
class _Tilt:
    """An event day: its place among the days, its events, and the points at which its members' product is taken."""

    place: int
    d: float
    log_z: float
    m: int                     # the points are the m-th roots of one; odd, so that -1 is none of them
    angles: np.ndarray         # of the points that count


def _tilts(patterns: DataFrame, beta: np.ndarray, events: _Events) -> list[_Tilt] | None:
    """The tilt z of each event day, chosen so that independent draws of the members at risk with odds w z give about as
    many as there are events. Any z gives the same result; it is found from counts per day and class of relative risk, which the driver gets. Days on
    which all members at risk have their event are left out: there is one set of them, whatever the coefficients. None if a
    relative risk is beyond the numbers."""
    risk = F.floor(F.log(F.col("w") / F.col("k")) / RISK_CLASS)
    rows = _weighted(patterns, beta).groupBy("t", risk.alias("c")).agg(F.sum("k").alias("k"), F.sum("w").alias("w")).collect()
    classes = {c: i for i, c in enumerate({r["c"] for r in rows})}
    k, w = np.zeros((2, len(events.days), len(classes)))
    for r in rows:
        at = np.searchsorted(events.days, r["t"]), classes[r["c"]]
        k[at], w[at] = r["k"], r["w"]
    k, w = k[::-1].cumsum(axis=0)[::-1], w[::-1].cumsum(axis=0)[::-1]
    place = np.flatnonzero((events.d > 0) & (events.d < k.sum(axis=1)))
    if not np.isfinite(w).all():
        return None
    if not len(place):
        return []
    d, k, w = events.d[place], k[place], w[place]
    logs = np.log(np.maximum(w / np.maximum(k, 1), 1e-300))
    target = np.minimum(d, k.sum(axis=1) - 0.5)
    drawn = lambda at: 1 / (1 + np.exp(-np.clip(at[:, None] + logs, -700, 700)))
    low, high = np.full(len(d), -logs.max() - 60.0), np.full(len(d), 60.0 - logs.min())
    for _ in range(70):
        middle = (low + high) / 2
        few = (k * drawn(middle)).sum(axis=1) < target
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    q = drawn(high)
    mean, variance = (k * q).sum(axis=1), (k * q * (1 - q)).sum(axis=1)
    out = []
    for i, v in enumerate(variance):
        # Bernstein's bound on what lies m and more from the mean; and |product| <= exp(-v (1 - cos angle)).
        m = math.ceil(EXACT_TAIL / 3 + math.sqrt(EXACT_TAIL**2 / 9 + 2 * EXACT_TAIL * v) + 2 * abs(mean[i] - d[i])) | 1
        angles = 2 * np.pi * np.arange(m // 2 + 1) / m
        out.append(_Tilt(int(place[i]), float(d[i]), float(high[i]), m, angles[v * (1 - np.cos(angles)) <= EXACT_TAIL]))
    return out


def _exact_days(counted: DataFrame, coef: np.ndarray, days: np.ndarray, tilts: Sequence[_Tilt]) -> np.ndarray:
    """Sums over some event days: the logarithm of the number of sets, the mean and the variance of their covariates, in one row."""
    p = len(coef)
    d, log_z, m, angles = [x.d for x in tilts], [x.log_z for x in tilts], [x.m for x in tilts], [x.angles for x in tilts]

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, whole = [np.zeros((len(a), 1 + p + p * p), dtype=complex) for a in angles], np.zeros(len(d))
        for b in batches:
            masks, of_row = np.unique(b.iloc[:, 2:].to_numpy(dtype=np.int64), axis=0, return_inverse=True) if p else (np.zeros((1, 0)), np.zeros(len(b), dtype=int))
            x = np.array([masks[:, i // BITS] >> i % BITS & 1 for i in range(p)], dtype=float).reshape(p, len(masks)).T
            last = np.searchsorted(days, b["t"].to_numpy(), side="right") - 1                     # the last event day a row is at risk
            at_risk = np.zeros((len(masks), len(d)))
            np.add.at(at_risk, (of_row.ravel()[last >= 0], last[last >= 0]), b["k"].to_numpy(dtype=float)[last >= 0])
            at_risk = at_risk[:, ::-1].cumsum(axis=1)[:, ::-1]
            for j, a in enumerate(angles):
                here = at_risk[:, j] > 0
                k, v, odds = at_risk[here, j], x[here], log_z[j] + x[here] @ coef
                q, rest = np.exp(-np.logaddexp(0, -odds)), np.exp(-np.logaddexp(0, odds))
                away = 2 * np.sin(a / 2) ** 2
                real, imaginary = 1 - np.outer(q, away), np.outer(q, np.sin(a))
                drawn = np.outer(q, np.exp(1j * a)) / (real + 1j * imaginary)
                parts[j][:, 0] += k @ (np.log1p(-2 * np.outer(q * rest, away)) / 2 + 1j * np.arctan2(imaginary, real))
                parts[j][:, 1:1 + p] += (v.T @ (k[:, None] * drawn)).T
                for i, spread in enumerate((k[:, None] * drawn * (1 - drawn)).T):
                    parts[j][i, 1 + p:] += ((v.T * spread) @ v).ravel()
                whole[j] += k @ np.logaddexp(0, odds)
        yield pd.DataFrame({"day": range(len(d)), "part": [x.tobytes() for x in parts], "whole": whole})

    def per_day(rows: pd.DataFrame) -> pd.DataFrame:
        j = int(rows["day"].iloc[0])
        a = angles[j]
        part = sum(np.frombuffer(x, dtype=complex).reshape(len(a), -1) for x in rows["part"])      # one for each task
        weight = np.exp(part[:, 0] - 1j * d[j] * a) * np.where(a > 0, 2, 1)                        # a point and its conjugate
        chance = weight.real.sum()
        centre = part[0, 1:1 + p].real
        off = part[:, 1:1 + p] - centre
        mean = (weight @ off).real / chance
        second = (weight @ part[:, 1 + p:]).real.reshape(p, p) + ((off.T * weight) @ off).real
        logs = np.log(chance / m[j]) + rows["whole"].sum() - d[j] * log_z[j]
        found = np.concatenate(([logs], centre + mean, (second / chance - np.outer(mean, mean)).ravel()))
        return pd.DataFrame({"day": [j], "sums": [found.tobytes()]})

    found = counted.mapInPandas(per_task, "day int, part binary, whole double").groupBy("day").applyInPandas(per_day, "day int, sums binary")
    return sum((np.frombuffer(bytes(r["sums"])) for r in found.toLocalIterator()), np.zeros(1 + p + p * p))


def _exact_pass(patterns: DataFrame, beta: np.ndarray, events: _Events) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information of the exact treatment of ties.

    The sum over all sets of d members is the coefficient of x^d in the product of (1 + w x) over the members at risk. With x = z u
    it is a constant times the chance that independent draws with odds w z give d members, which is a mean of the product over
    roots u of one. Only points near 1 count, some 15 to 20 a day however many events it has (see ``_tilts``), and the logarithm
    of the product is a sum over the members, as are its derivatives: each task adds up its patterns' parts per day and
    point, then they are added across tasks, a row for each day and task. The work for a pattern does not grow with the events of a day."""
    p, most, coef = len(beta), int(events.d.max()), np.where(beta == beta, beta, 0.0)
    tilts = _tilts(patterns, beta, events)
    if tilts is None:
        return math.nan, np.zeros(p), np.zeros((p, p))
    if not tilts and most > EXACT_EVENTS:
        raise ValueError(f"{most} tied events in a day, and nobody else is at risk on any event day: exact ties tell nothing of it; use efron")
    counted = patterns.groupBy("t", *_masks(p)).agg(F.sum("k").alias("k")).select("t", "k", *_masks(p))
    dx = events.dx[[x.place for x in tilts]].sum(axis=0)
    total = np.zeros(1 + p + p * p)
    while tilts:
        numbers = np.cumsum([len(x.angles) for x in tilts]) * (1 + p + p * p)
        n = max(1, int(np.searchsorted(numbers, EXACT_NUMBERS, side="right")))
        total += _exact_days(counted, coef, events.days[[x.place for x in tilts[:n]]], tilts[:n])
        tilts = tilts[n:]
    return float(dx @ coef) - float(total[0]), dx - total[1:1 + p], total[1 + p:].reshape(p, p)


def _step(patterns: DataFrame, events: _Events, ties: str) -> tuple[Callable, Callable]:
    """The two parts of a Newton step: sums with log likelihood and score, and the information of these sums."""
    if ties == "exact":
        def sums(beta: np.ndarray) -> _Sums:
            loglik, score, info = _exact_pass(patterns, beta, events)
            return _Sums(loglik, score, info, np.zeros(0), np.zeros(0))
        return sums, lambda beta, s: s.mean_outer
    tie_sums = _tie_sums if ties == "efron" else _same_risk
    if 2 * len(events.days) * (events.dx.shape[1] + 1) ** 2 <= CROSS_NUMBERS:
        return (lambda beta: _one_pass(patterns, beta, events, tie_sums)), lambda beta, s: s.mean_outer
    return (lambda beta: _first_pass(patterns, beta, events, tie_sums)), (lambda beta, s: _second_pass(patterns, beta, events, s))


def _independent(info: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Which columns are not determined by the ones before them (swept in order)."""
    a = info.copy()
    keep = np.zeros(len(a), dtype=bool)
    for j in range(len(a)):
        if a[j, j] > tol * max(info[j, j], tol):
            keep[j] = True
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
    return keep


def cox_ph(df: DataFrame, time: str, event: str, covariates: Sequence[Covariate], max_steps: int = 20,
           tol: float = 1e-9, keep: Callable[[DataFrame], DataFrame] = durable, ties: str = "efron") -> CoxFit:
    """Newton-Raphson from zero with step halving; terms determined by earlier ones are left out.

    Levels that no covariate declares are an error. A fit that did not converge says so in every table made of it.
    ``keep`` writes the pattern table once (a reliable checkpoint by default). ``ties`` is ``efron``, ``breslow`` (all events of a day
    meet the whole risk set) or ``exact`` (the events of a day as one set among all sets of that size)."""
    if ties not in ("efron", "breslow", "exact"):
        raise ValueError("ties is 'efron', 'breslow' or 'exact'")
    covariates = list(covariates)
    odd = undeclared_levels(df, covariates).limit(20).collect() if covariates else []
    if odd:
        raise ValueError(f"undeclared levels: {sorted((r['variable'], r['level']) for r in odd)}")
    patterns, terms = _patterns(df, time, event, covariates, keep)
    missing = df.count()
    counts = patterns.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("e")).alias("d")).first()
    n, n_events = int(counts["n"] or 0), int(counts["d"] or 0)
    if n_events == 0:
        raise ValueError("the model needs at least one event")
    beta = np.zeros(len(terms))
    events = _events(patterns, len(terms))
    sums_at, info_at = _step(patterns, events, ties)
    sums = sums_at(beta)
    info = info_at(beta, sums)
    free = _independent(info)
    solve = lambda m, v: np.linalg.solve(m[np.ix_(free, free)], v[free])
    null, score0 = sums.loglik, float(sums.score[free] @ solve(info, sums.score)) if free.any() else 0.0
    converged, step = not bool(free.any()), 0
    while not converged and step < max_steps:
        step += 1
        move = np.zeros_like(beta)
        move[free] = solve(info, sums.score)
        new = sums_at(beta + move)
        halvings = 0
        while not new.loglik >= sums.loglik - 1e-9 * abs(sums.loglik) and halvings < 10:
            move, halvings = move / 2, halvings + 1
            new = sums_at(beta + move)
        converged = bool(abs(1 - sums.loglik / new.loglik) <= tol)
        beta, sums = beta + move, new
        info = info_at(beta, sums)
    wald = float(beta[free] @ info[np.ix_(free, free)] @ beta[free])
    se = np.full(len(beta), np.nan)
    if free.any():
        se[free] = np.sqrt(np.diag(np.linalg.inv(info[np.ix_(free, free)])))
    return CoxFit(terms, np.where(free, beta, np.nan), se, null, sums.loglik, score0, wald, n, n_events, missing - n, step, converged,
                  time, event, covariates, patterns)


def tidy_cox(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """One row per term: estimate, standard error, z, p-value and 95% limits (null if left out)."""
    rows = []
    for i, term in enumerate(fit.terms):
        if not fit.used[i]:
            rows.append((i + 1, term, None, None, None, None, None, None, fit.converged))
            continue
        b, se = float(fit.beta[i]), float(fit.se[i])
        z = b / se
        rows.append((i + 1, term, b, se, z, math.erfc(abs(z) / math.sqrt(2)), b - Z95 * se, b + Z95 * se, fit.converged))
    return spark.createDataFrame(rows, "term_no int, term string, estimate double, std_error double, statistic double, "
                                       "p_value double, conf_low double, conf_high double, converged boolean")


def _log_risk(beta: np.ndarray) -> Column:
    score = F.lit(0.0)
    for i, b in enumerate(beta):
        if b != 0.0 and not math.isnan(b):
            score = score + F.expr(bit(i)) * F.lit(float(b))
    return score


def join_estimates(coefficients: DataFrame, limits: DataFrame) -> DataFrame:
    """Put a table of coefficients and a table of confidence limits together by term."""
    return coefficients.join(limits, "term", "inner")


def concordance(fit: CoxFit) -> DataFrame:
    """Concordant, discordant and tied pairs of an event and a member still at risk after it.

    Exact without forming pairs: patterns are counted per (score, time, event) and range-partitioned
    by score. Each partition counts its own pairs from running totals per day and reports its totals
    per day; pairs across partitions follow from those totals, because the ranges are ordered.
    """
    score = F.round(_log_risk(np.where(fit.used, fit.beta, 0.0)), 12)
    counted = (fit.patterns.groupBy(score.alias("score"), "t", "e").agg(F.sum("k").alias("k")))
    spread = counted.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id())
    last, block = counted.agg(F.max("t")).first()[0], 1_000

    def later(ev: np.ndarray, ce: np.ndarray) -> np.ndarray:
        """Members whose time is after each day, or censored on it."""
        return np.concatenate([np.cumsum((ev + ce)[::-1])[::-1][1:], [0.0]]) + ce

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen_event, seen_cens = np.zeros(last + 2), np.zeros(last + 2)
        below = tied = above = 0.0
        part, held = -1, None

        def take(rows: pd.DataFrame):
            """Add whole scores in rising order, as matrices of scores x days."""
            nonlocal below, tied, above, seen_event, seen_cens
            scores, code = np.unique(rows["score"].to_numpy(), return_inverse=True)
            t, e, k = rows["t"].to_numpy(), rows["e"].to_numpy(), rows["k"].to_numpy()
            for start in range(0, len(scores), block):
                here = (code >= start) & (code < start + block)
                size = min(block, len(scores) - start)
                both = np.zeros((2, size, last + 2))
                np.add.at(both, (e[here], code[here] - start, t[here]), k[here])
                ce, ev = both
                surv_after = np.cumsum((ev + ce)[:, ::-1], axis=1)[:, ::-1]
                stay = np.concatenate([surv_after[:, 1:], np.zeros((size, 1))], axis=1) + ce
                lower_stay = np.cumsum(stay, axis=0) - stay + later(seen_event, seen_cens)
                lower_event = np.cumsum(ev, axis=0) - ev + seen_event
                below += float((ev * lower_stay).sum())          # event here, survivor with lower score
                above += float((stay * lower_event).sum())       # event with lower score, survivor here
                tied += float((ev * stay).sum())
                seen_event, seen_cens = seen_event + ev.sum(axis=0), seen_cens + ce.sum(axis=0)

        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            b = b if held is None else pd.concat([held, b])
            open_score = b["score"] == b["score"].iloc[-1]       # may go on in the next batch
            held = b[open_score]
            take(b[~open_score])
        if held is not None:
            take(held)
        if part >= 0:
            yield pd.DataFrame({"part": part, "t": np.arange(last + 2), "ev": seen_event, "ce": seen_cens,
                                "below": [below] + [0.0] * (last + 1), "above": [above] + [0.0] * (last + 1),
                                "tied": [tied] + [0.0] * (last + 1)})

    per_part = spread.mapInPandas(count, "part int, t int, ev double, ce double, below double, above double, tied double")
    rows = per_part.where("ev > 0 OR ce > 0 OR t = 0").toPandas()                    # partitions x days
    conc, disc, tied = rows["below"].sum(), rows["above"].sum(), rows["tied"].sum()
    seen_event, seen_cens = np.zeros(last + 2), np.zeros(last + 2)
    for _, g in rows.groupby("part", sort=True):
        ev, ce = np.zeros(last + 2), np.zeros(last + 2)
        ev[g["t"]], ce[g["t"]] = g["ev"], g["ce"]
        conc += ev @ later(seen_event, seen_cens)
        disc += seen_event @ later(ev, ce)
        seen_event, seen_cens = seen_event + ev, seen_cens + ce
    pairs = conc + disc + tied
    value = float((conc + tied / 2) / pairs) if pairs else None
    return fit.patterns.sparkSession.createDataFrame(
        [(int(conc), int(disc), int(tied), value)], "concordant long, discordant long, tied_risk long, concordance double")


def cox_glance(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """Fit summary: sizes, log likelihoods, AIC, the three global tests and the concordance."""
    lr = 2 * (fit.loglik - fit.loglik_null)
    p = fit.dof
    base = spark.createDataFrame(
        [(fit.n, fit.n_events, fit.n_left_out, p, fit.loglik_null, fit.loglik, -2 * fit.loglik + 2 * p, lr, chi2_tail(lr, p),
          fit.score_test, chi2_tail(fit.score_test, p), fit.wald_test, chi2_tail(fit.wald_test, p), fit.iterations, fit.converged)],
        "n long, n_events long, n_left_out long, df int, loglik_null double, loglik double, aic double, lr_test double, lr_p double, "
        "score_test double, score_p double, wald_test double, wald_p double, iterations int, converged boolean")
    c = concordance(fit).first()
    return base.withColumn("concordance", F.lit(c["concordance"]).cast("double"))


def level_counts(fit: CoxFit) -> DataFrame:
    """Members per level of every covariate in the model, reference levels included."""
    sums = _sum_of_bits("k", "x", len(fit.terms))
    parts, i = [], 0
    for no, cov in enumerate(fit.covariates, 1):
        cols = [F.col(f"x{i + j}") for j in range(len(cov.levels) - 1)]
        i += len(cols)
        rest = F.col("n")
        for c in cols:
            rest = rest - c
        for level, value in zip(cov.levels, [rest, *cols]):
            parts.append(F.struct(F.lit(no).alias("variable_no"), F.lit(cov.name).alias("variable"),
                                  F.lit(level).alias("level"), value.alias("n")))
    return fit.patterns.agg(F.sum("k").alias("n"), *sums).select(F.inline(F.array(*parts)))

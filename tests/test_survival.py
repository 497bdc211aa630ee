import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlib import ADULT, CHILD
from cohortlib.operators import cox, survival
from cohortlib.spec import Covariate

SMALL = [(1, 1, "b"), (1, 0, "b"), (6, 1, "b"), (6, 1, "a"), (8, 0, "a"), (9, 1, "a")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, "time int, event int, x string")


def random_members(n, seed, tied_days=12):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        g, h, s = rnd.choice(["M", "F"]), rnd.choice(["p", "q", "r"]), rnd.choice(["No", "Yes"])
        t = min(tied_days, 1 + int(rnd.expovariate(0.15 * math.exp(0.5 * (g == "F") - 0.7 * (h == "r")))))
        out.append((t, int(t < tied_days and rnd.random() < 0.8), g, h, s))
    return out


COVS = [Covariate("g", ("M", "F")), Covariate("h", ("p", "q", "r")), Covariate("s", ("No", "Yes"))]
SCHEMA = "time int, event int, g string, h string, s string"


def matrix(data):
    x = np.array([[r[2] == "F", r[3] == "q", r[3] == "r", r[4] == "Yes"] for r in data], dtype=float)
    return np.array([r[0] for r in data]), np.array([r[1] for r in data]), x


def efron(t, e, x, beta):
    """Log partial likelihood, gradient and information, member by member."""
    p = x.shape[1]
    ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
    w = np.exp(x @ beta)
    for day in np.unique(t[e == 1]):
        risk, dead = t >= day, (t == day) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        for l in range(d):
            ww = np.where(risk, w, 0) - np.where(dead, w * l / d, 0)
            s0, s1 = ww.sum(), ww @ x
            ll -= math.log(s0)
            u += -s1 / s0
            info += (x * ww[:, None]).T @ x / s0 - np.outer(s1, s1) / s0**2
        u += x[dead].sum(axis=0)
    return ll, u, info


def test_surv_checks_values(spark, small):
    assert survival.surv(spark.createDataFrame([(1, 1), (None, 1), (2, None)], "time int, event int"), "time", "event").count() == 1
    with pytest.raises(Exception, match="event must be"):
        survival.surv(spark.createDataFrame([(1, 2)], "time int, event int"), "time", "event").collect()


def test_kaplan_meier_small(spark):
    rows = [(1, 1)] + [(2, 1)] * 2 + [(3, 0)] * 3 + [(5, 1)] * 4
    got = survival.kaplan_meier(spark.createDataFrame(rows, "t int, e int"), "t", "e").orderBy("time").collect()
    assert [(r["time"], r["n_risk"], r["n_event"]) for r in got] == [(1, 10, 1), (2, 9, 2), (5, 4, 4)]
    assert [r["survival"] for r in got] == pytest.approx([0.9, 0.7, 0.0])
    se = 0.7 * math.sqrt(1 / (10 * 9) + 2 / (9 * 7))
    assert got[1]["std_err"] == pytest.approx(se)
    assert got[1]["conf_low"] == pytest.approx(0.7 * math.exp(-1.959963984540054 * se / 0.7))
    assert got[0]["conf_high"] == 1.0 and got[2]["std_err"] is None and got[2]["conf_low"] is None
    km = spark.createDataFrame(got)
    assert survival.km_median(km).first()["median_time"] == 5
    assert survival.survival_at(km, 4).first()["survival"] == pytest.approx(0.7)
    assert survival.survival_at(km, 0).first()["survival"] == 1.0


def test_curves_never_rise_and_strata_are_complete(spark):
    df = spark.createDataFrame(random_members(300, 2) + [(3, 1, None, "p", "No")], SCHEMA)
    got = survival.kaplan_meier(df, "time", "event", ["g"]).orderBy("g", "time").collect()
    assert {r["g"] for r in got} == {"M", "F"}
    for a, b in itertools.pairwise(got):
        if a["g"] == b["g"]:
            assert b["survival"] <= a["survival"] and b["n_risk"] < a["n_risk"]


def test_chi2_tail():
    assert survival.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert survival.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert survival.chi2_tail(40.0, 3) == pytest.approx(1.0655e-08, rel=1e-3)
    assert survival.chi2_tail(0.0, 2) == 1.0


@pytest.mark.parametrize("by", ["g", "h"])
def test_logrank_against_brute_force(spark, by):
    data = random_members(200, 5)
    col = {"g": 2, "h": 3}[by]
    groups = sorted({r[col] for r in data})
    k = len(groups)
    o, e, v = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for day in {r[0] for r in data if r[1]}:
        n = np.array([sum(r[0] >= day and r[col] == g for r in data) for g in groups], dtype=float)
        d = np.array([sum(r[0] == day and r[1] and r[col] == g for r in data) for g in groups], dtype=float)
        o, e = o + d, e + d.sum() * n / n.sum()
        if n.sum() > 1:
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    chisq = (o - e)[:-1] @ np.linalg.solve(v[:-1, :-1], (o - e)[:-1])
    df = spark.createDataFrame(data, SCHEMA)
    got = {r[by]: r for r in survival.logrank(df, "time", "event", by).collect()}
    table = {r[by]: r for r in survival.logrank_table(df, "time", "event", by).collect()}
    for i, g in enumerate(groups):
        for r in (got[g], table[g]):
            assert (r["observed"], r["expected"], r["variance"]) == pytest.approx((o[i], e[i], v[i, i]))
        assert got[g]["chisq"] == pytest.approx(chisq) and got[g]["df"] == k - 1
    assert sum(r["expected"] for r in table.values()) == pytest.approx(sum(r["observed"] for r in table.values()))


def test_published_small_case(small):
    fit = cox.cox_ph(small, "time", "event", [Covariate("x", ("a", "b"))])
    assert fit.beta[0] == pytest.approx(1.676857, abs=1e-6)
    assert fit.se[0] == pytest.approx(1.277616, abs=1e-6)
    assert fit.loglik == pytest.approx(-3.358975, abs=1e-6)


def test_reference_level_turns_the_sign(small):
    fit = cox.cox_ph(small, "time", "event", [Covariate("x", ("b", "a"))])
    assert fit.terms == ["xa"] and fit.beta[0] == pytest.approx(-1.676857, abs=1e-6)


@pytest.mark.parametrize("parts", [1, 8])
def test_fit_against_brute_force(spark, parts):
    data = random_members(300, 11)
    fit = cox.cox_ph(spark.createDataFrame(data, SCHEMA).repartition(parts), "time", "event", COVS)
    t, e, x = matrix(data)
    ll, u, info = efron(t, e, x, fit.beta)
    assert fit.terms == ["gF", "hq", "hr", "sYes"] and fit.converged and fit.n == 300 and fit.n_events == e.sum()
    assert fit.loglik == pytest.approx(ll) and np.abs(u).max() < 1e-5
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))))
    ll0, u0, info0 = efron(t, e, x, np.zeros(4))
    assert fit.loglik_null == pytest.approx(ll0) and fit.score_test == pytest.approx(u0 @ np.linalg.solve(info0, u0))
    got = cox.tidy_cox(spark, fit).orderBy("term_no").collect()
    assert [r["estimate"] for r in got] == pytest.approx(list(fit.beta))


def test_determined_terms_are_left_out(spark):
    data = [(*r, "No", r[4]) for r in random_members(120, 4)]
    df = spark.createDataFrame(data, SCHEMA + ", never string, copy string")
    fit = cox.cox_ph(df, "time", "event", [*COVS, Covariate("never", ("No", "Yes")), Covariate("copy", ("No", "Yes"))])
    assert list(fit.used) == [True] * 4 + [False, False] and fit.dof == 4
    plain = cox.cox_ph(df, "time", "event", COVS)
    assert fit.beta[:4] == pytest.approx(plain.beta) and fit.loglik == pytest.approx(plain.loglik)
    last = cox.tidy_cox(spark, fit).where("term = 'copyYes'").first()
    assert last["estimate"] is None and last["p_value"] is None


def test_rows_with_missing_covariates_are_left_out(spark):
    data = random_members(100, 8)
    df = spark.createDataFrame(data + [(3, 1, None, "p", "No"), (None, 1, "M", "p", "No")], SCHEMA)
    fit = cox.cox_ph(df, "time", "event", COVS)
    assert (fit.n, fit.n_left_out, fit.converged) == (100, 2, True)


def test_undeclared_levels_are_an_error(spark):
    df = spark.createDataFrame(random_members(100, 8) + [(3, 1, "M", "other", "No")], SCHEMA)
    with pytest.raises(ValueError, match="other"):
        cox.cox_ph(df, "time", "event", COVS)


def test_a_fit_that_did_not_converge_says_so(spark):
    df = spark.createDataFrame(random_members(100, 8), SCHEMA)
    fit = cox.cox_ph(df, "time", "event", COVS, max_steps=1)
    assert not fit.converged and {r["converged"] for r in cox.tidy_cox(spark, fit).collect()} == {False}
    assert cox.cox_glance(spark, fit).first()["converged"] is False


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 8)])
def test_concordance_against_all_pairs(spark, seed, parts):
    data = random_members(150, seed)
    df = spark.createDataFrame(data, SCHEMA)
    fit = cox.cox_ph(df, "time", "event", COVS)
    t, e, x = matrix(data)
    score = np.round(x @ fit.beta, 12)
    conc = disc = tied = 0
    for i, j in itertools.permutations(range(len(data)), 2):
        if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
            conc += score[i] > score[j]
            disc += score[i] < score[j]
            tied += score[i] == score[j]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = cox.concordance(fit).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert (r["concordant"], r["discordant"], r["tied_risk"]) == (conc, disc, tied)
    assert r["concordance"] == pytest.approx((conc + tied / 2) / (conc + disc + tied))


def test_fit_summary_and_levels(spark):
    data = random_members(200, 21)
    fit = cox.cox_ph(spark.createDataFrame(data, SCHEMA), "time", "event", COVS)
    r = cox.cox_glance(spark, fit).first()
    assert r["aic"] == pytest.approx(-2 * fit.loglik + 8) and r["lr_test"] == pytest.approx(2 * (fit.loglik - fit.loglik_null))
    assert 0.5 < r["concordance"] < 1
    levels = {(r["variable"], r["level"]): r["n"] for r in cox.level_counts(fit).collect()}
    assert levels[("h", "p")] == sum(d[3] == "p" for d in data) and levels[("g", "F")] == sum(d[2] == "F" for d in data)


def test_estimates_and_limits_join_by_term(spark, small):
    tidy = cox.tidy_cox(spark, cox.cox_ph(small, "time", "event", [Covariate("x", ("a", "b"))]))
    joined = cox.join_estimates(tidy.select("term", "estimate"), tidy.select("term", "conf_low", "conf_high"))
    assert joined.columns == ["term", "estimate", "conf_low", "conf_high"] and joined.count() == 1


@pytest.mark.parametrize("d,risk,tied", [(50_000, 60_000.0, 50_000.0), (50_000, 50_000.0, 50_000.0), (1_000_000, 1e9, 1.3e6), (9_000, 9_100.5, 9_100.4)])
def test_tie_sums_of_many_events(d, risk, tied):
    assert cox._tie_sums(d, risk, tied) == pytest.approx(cox._tie_sums(d, risk, tied, exact=d), rel=1e-10)


def test_tie_sums_take_no_longer_for_more_events():
    sums = cox._tie_sums(10**9, 3e9, 1.1e9)
    assert sums[1] == pytest.approx(1e9 / 1.1e9 * math.log(3 / 1.9), rel=1e-8)


def test_hazard_ratio_table(spark):
    tidy = spark.createDataFrame([("After_OPYes", 0.5, 0.01, 0.1, 0.9), ("RaceCatBlack", -0.5, 0.05, -0.9, -0.1),
                                  ("zzz", 0.1, 0.5, -0.1, 0.3), ("FirstEpEverY", None, None, None, None)],
                                 "term string, estimate double, p_value double, conf_low double, conf_high double")
    out = survival.label_terms(survival.hazard_ratio_columns(tidy), survival.term_labels(ADULT))
    got = {r["term"]: r for r in out.collect()}
    assert got["After_OPYes"]["RiskImpact"] == "Increases Risk" and got["After_OPYes"]["HR"] == pytest.approx(math.exp(0.5))
    assert got["RaceCatBlack"]["RiskImpact"] == "Decreases Risk" and got["RaceCatBlack"]["factors"] == "Black (ref: White)"
    assert got["zzz"]["RiskImpact"] == "No Impact" and got["zzz"]["factors"] == "ERROR"
    assert got["FirstEpEverY"]["sig"] is None and got["FirstEpEverY"]["RiskImpact"] is None
    assert [r["term"] for r in survival.unlabelled_terms(out).collect()] == ["zzz"]
    assert survival.significant(out).count() == 2


@pytest.mark.parametrize("spec", [ADULT, CHILD])
def test_every_term_has_a_label(spec):
    labels = survival.term_labels(spec)
    assert "ERROR" not in labels.values()
    assert len(labels) == sum(len(c.levels) - 1 for c in spec.covariates)
    assert len(spec.covariates) == (23 if spec is ADULT else 28)


def test_known_labels():
    adult, child = survival.term_labels(ADULT), survival.term_labels(CHILD)
    assert adult["LOScatLT 5 days"] == "LOS Under 5 (ref: 5+)" and adult["Yr1Prior_23HrBedYes"] == "Yr1Prior: 23 Hr Bed"
    assert adult["eligcatNo Elig"] == "Yr1Prior: Elig 0 Days (ref: 50+%)" and adult["AgeCat251+"] == "51+ (ref: 18-30yo)"
    assert child["Yr1Prior_BHRS_CTSSYes"] == "YrPrior: BHRS/CTSS" and child["VoluntaryVoluntary"] == "Voluntary Commitment"
    assert child["Yr1Prior_AnyAIPYes"] == "Yr1Prior: AIP" and child["RaceCatWhite"] == "White (ref: Black)"


def exact(t, e, x, beta):
    """Log likelihood where the events of a day are one of all sets of that size, by going through the sets."""
    ll, w = 0.0, np.exp(x @ beta)
    for day in np.unique(t[e == 1]):
        risk, dead = np.flatnonzero(t >= day), np.flatnonzero((t == day) & (e == 1))
        ll += (x[dead] @ beta).sum() - math.log(sum(np.prod(w[list(c)]) for c in itertools.combinations(risk, len(dead))))
    return ll


def slopes(f, beta, h=1e-4):
    """Gradient and negative second derivatives by differences."""
    p, eye = len(beta), np.eye(len(beta)) * h
    g = np.array([(f(beta + eye[i]) - f(beta - eye[i])) / (2 * h) for i in range(p)])
    i = np.array([[-(f(beta + eye[a] + eye[b]) - f(beta + eye[a] - eye[b]) - f(beta - eye[a] + eye[b]) + f(beta - eye[a] - eye[b])) / (4 * h * h)
                   for b in range(p)] for a in range(p)])
    return g, i


def test_exact_ties(spark):
    data = random_members(16, 4, tied_days=4)
    t, e, x = matrix(data)
    fit = cox.cox_ph(spark.createDataFrame(data, SCHEMA), "time", "event", COVS[:1], ties="exact")
    f = lambda b: exact(t, e, x[:, :1], b)
    assert fit.loglik_null == pytest.approx(f(np.zeros(1)), abs=1e-10) and fit.loglik == pytest.approx(f(fit.beta), abs=1e-10)
    gradient, info = slopes(f, fit.beta)
    assert abs(gradient[0]) < 1e-5 and fit.se[0] == pytest.approx(info[0, 0] ** -0.5, rel=1e-4)
    events = cox._events(fit.patterns, 1)
    for beta in (np.array([0.4]), np.array([-1.3])):
        loglik, score, information = cox._exact_pass(fit.patterns, beta, events)
        gradient, info = slopes(f, beta)
        assert loglik == pytest.approx(f(beta), abs=1e-10) and score == pytest.approx(gradient, abs=1e-5) and information == pytest.approx(info, abs=1e-4)


def test_exact_ties_of_several_terms(spark):
    data = random_members(14, 8, tied_days=3)
    t, e, x = matrix(data)
    patterns, _ = cox._patterns(spark.createDataFrame(data, SCHEMA), "time", "event", COVS, lambda df: df)
    beta = np.array([0.3, -0.2, 0.5, 0.1])
    loglik, score, info = cox._exact_pass(patterns, beta, cox._events(patterns, 4))
    f = lambda b: exact(t, e, x, b)
    gradient, want = slopes(f, beta)
    assert loglik == pytest.approx(f(beta), abs=1e-10) and score == pytest.approx(gradient, abs=1e-5) and info == pytest.approx(want, abs=1e-4)


def two_groups(t, e, x, b):
    """Log likelihood, slope and information with one 0/1 covariate: the events of a day hold j of the n1 members that have it."""
    ll = slope = info = 0.0
    ways = lambda n, j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
    for day in np.unique(t[e == 1]):
        risk, dead = t >= day, (t == day) & (e == 1)
        n, n1, d, d1 = int(risk.sum()), int(x[risk].sum()), int(dead.sum()), int(x[dead].sum())
        j = np.arange(max(0, d - n + n1), min(d, n1) + 1)
        logs = np.array([ways(n1, i) + ways(n - n1, d - i) + i * b for i in j])
        h = np.exp(logs - logs.max())
        mean = (j * h).sum() / h.sum()
        ll += d1 * b - math.log(h.sum()) - logs.max()
        slope += d1 - mean
        info += ((j - mean) ** 2 * h).sum() / h.sum()
    return ll, slope, info


@pytest.mark.parametrize("n,days", [(9000, 4), (40000, 2), (3000, 1)])
def test_exact_ties_of_many_events_a_day(spark, n, days):
    """Far more than 400 events a day, also on a day on which all but a few at risk have theirs."""
    r = random.Random(n)
    data = [(r.randint(1, days), int(r.random() < (0.999 if n == 3000 else 0.5)), r.choice("MF")) for _ in range(n)]
    fit = cox.cox_ph(spark.createDataFrame(data, "time int, event int, g string"), "time", "event", COVS[:1], ties="exact")
    t, e, x = np.array([d[0] for d in data]), np.array([d[1] for d in data]), np.array([d[2] == "F" for d in data], dtype=float)
    assert max(np.bincount(t[e == 1])) > cox.EXACT_EVENTS
    ll, slope, info = two_groups(t, e, x, fit.beta[0])
    assert fit.converged and abs(slope) < 1e-4 and fit.loglik == pytest.approx(ll, rel=1e-10)
    assert fit.se[0] == pytest.approx(info ** -0.5, rel=1e-8)
    for beta in (0.0, 1.5, -4.0):
        got = cox._exact_pass(fit.patterns, np.array([beta]), cox._events(fit.patterns, 1))
        want = two_groups(t, e, x, beta)
        assert got[0] == pytest.approx(want[0], rel=1e-10) and got[1][0] == pytest.approx(want[1], rel=1e-7, abs=1e-7)
        assert got[2][0, 0] == pytest.approx(want[2], rel=1e-7)


def test_exact_ties_in_several_goes(spark, monkeypatch):
    df = spark.createDataFrame(random_members(400, 9), SCHEMA)
    one = cox.cox_ph(df, "time", "event", COVS, ties="exact")
    monkeypatch.setattr(cox, "EXACT_NUMBERS", 1)
    some = cox.cox_ph(df, "time", "event", COVS, ties="exact")
    assert some.loglik == pytest.approx(one.loglik, abs=1e-9) and some.beta == pytest.approx(one.beta, abs=1e-9) and some.se == pytest.approx(one.se, abs=1e-9)


def test_breslow_ties(spark):
    data = random_members(60, 5)
    t, e, x = matrix(data)

    def f(beta):
        w = np.exp(x @ beta)
        return sum((x[i] @ beta) - math.log(w[t >= t[i]].sum()) for i in np.flatnonzero(e))
    fit = cox.cox_ph(spark.createDataFrame(data, SCHEMA), "time", "event", COVS, ties="breslow")
    gradient, info = slopes(f, fit.beta)
    assert fit.loglik == pytest.approx(f(fit.beta), abs=1e-9) and np.abs(gradient).max() < 1e-4
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-4)


def test_ties_agree_without_ties(spark):
    r = random.Random(2)
    data = [(d + 1, r.randint(0, 1), r.choice("MF"), "p", "No") for d in range(30)]
    df = spark.createDataFrame(data, SCHEMA)
    fits = [cox.cox_ph(df, "time", "event", COVS[:1], ties=m) for m in ("efron", "breslow", "exact")]
    assert [f.loglik for f in fits] == pytest.approx([fits[0].loglik] * 3) and [f.beta[0] for f in fits] == pytest.approx([fits[0].beta[0]] * 3)
    with pytest.raises(ValueError, match="ties is"):
        cox.cox_ph(df, "time", "event", COVS[:1], ties="other")


def test_too_many_ties_for_the_exact_way(spark):
    df = spark.range(2000).selectExpr("1 AS time", "1 AS event", "IF(id % 2 = 0, 'M', 'F') AS g")
    with pytest.raises(ValueError, match="use efron"):
        cox.cox_ph(df, "time", "event", COVS[:1], ties="exact")


def test_passes_use_no_python_workers(spark):
    patterns, terms = cox._patterns(spark.createDataFrame(random_members(50, 1), SCHEMA), "time", "event", COVS, lambda df: df)
    assert patterns.columns == ["t", "e", "m0", "k"] and len(terms) == 4
    plan = cox._weighted(patterns, np.zeros(4))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_more_terms_than_one_number_holds(spark):
    """Seventy levels lie in two whole numbers; their estimates are those of the member-by-member computation."""
    r = random.Random(7)
    levels = tuple(f"v{i:02d}" for i in range(70))
    data = [(r.randint(1, 9), int(r.random() < 0.7), r.choice(levels), r.choice("MF")) for _ in range(1500)]
    df = spark.createDataFrame(data, "time int, event int, v string, g string")
    fit = cox.cox_ph(df, "time", "event", [Covariate("v", levels), Covariate("g", ("M", "F"))])
    assert {"m0", "m1"} <= set(fit.patterns.columns)
    t, e = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    x = np.array([[d[2] == lv for lv in levels[1:]] + [d[3] == "F"] for d in data], dtype=float)
    ll, u, info = efron(t, e, x, fit.beta)
    assert fit.loglik == pytest.approx(ll, abs=1e-8) and np.abs(u).max() < 1e-4
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-6)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_one_pass_and_two_give_the_same_fit(spark, monkeypatch, ties):
    df = spark.createDataFrame(random_members(300, 3), SCHEMA)
    one = cox.cox_ph(df, "time", "event", COVS, ties=ties)
    monkeypatch.setattr(cox, "CROSS_NUMBERS", 0)
    two = cox.cox_ph(df, "time", "event", COVS, ties=ties)
    assert one.loglik == pytest.approx(two.loglik, abs=1e-9) and one.beta == pytest.approx(two.beta, abs=1e-9) and one.se == pytest.approx(two.se, abs=1e-9)

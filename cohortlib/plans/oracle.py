"""SQL counterparts of the named queries, for an engine with the same tables registered as views.

Written from the definitions of the measures, independently of the Spark operators: for example,
eligible days are counted here as distinct calendar days, while Spark merges spans. Bands, windows, code sets and level
orders come from the same ``RunSpec``, which is the input of both.
"""

from __future__ import annotations

from collections.abc import Iterable

from cohortlib.sources.tables import LOC_GROUPS, SEGMENT_RACE
from cohortlib.spec import (ADULT, CHILD, ELIG_DAY_BANDS, ELIG_YEAR_BANDS, MONTH_BANDS, RACE_MAP, WEEK_BANDS, Bands,
                            RunSpec)

_CODE = "p.p_type || CASE WHEN p.p_partkey % 2 = 0 THEN '' ELSE ' 2' END"
DIMS = "BA_Category, Measure_Name, Measure_Period, LOC"


# ---- text helpers -------------------------------------------------------------------------------------

def _q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _in(values: Iterable[str]) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _case(expr: str, mapping: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


def _band(expr: str, bands: Bands) -> str:
    null = "NULL" if bands.null_label is None else _q(bands.null_label)
    whens = " ".join(f"WHEN {expr} <= {cut} THEN {_q(label)}" for cut, label in zip(bands.cuts, bands.labels))
    return f"CASE WHEN {expr} IS NULL THEN {null} {whens} ELSE {_q(bands.labels[-1])} END"


def _level(expr: str, levels: Iterable[str]) -> str:
    levels = list(levels)
    whens = " ".join(f"WHEN {expr} = {_q(v)} THEN {i}" for i, v in enumerate(levels, 1))
    return f"CASE WHEN {expr} IS NULL THEN {len(levels) + 2} {whens} ELSE {len(levels) + 1} END"


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


def _strict(expr: str) -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN CAST(sum({expr}) AS BIGINT) END"


# ---- shared relations -----------------------------------------------------------------------------------

def _base(spec: RunSpec) -> list[tuple[str, str]]:
    """Relations up to the cleaned long table and the member table, in order."""
    adult = spec.name == "adult"
    codes = _in(spec.index_codes)
    year = spec.year_days
    days = spec.follow_up_days
    additional_loc = (
        "CASE WHEN o_orderkey % 29 = 0 THEN '(450-1) HOST HOMES - DHS CHILD' WHEN o_orderkey % 3 = 0 THEN 'EAC' "
        "WHEN o_orderkey % 3 = 1 THEN 'JoH' ELSE 'RTFA' END" if adult else
        "CASE WHEN o_orderkey % 2 = 0 THEN 'Host Homes' ELSE 'Stepping Stones' END")
    age = "18 + (c_custkey * 7) % 60" if adult else "5 + (c_custkey * 7) % 13"

    def spans(priority: str, length: str, extra: str = "", where: str = "") -> str:
        return (f"SELECT o_custkey AS member, CAST(o_orderdate AS DATE) AS b, "
                f"CASE WHEN o_orderkey % 37 = 0 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + CAST({length} AS INTEGER) END AS e{extra} "
                f"FROM orders WHERE o_orderpriority = '{priority}'{where}")

    def calendar(source: str) -> str:
        return (f"SELECT member, CAST(unnest(generate_series(CAST(b AS TIMESTAMP), CAST(least(e, DATE '2003-01-01') - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day "
                f"FROM {source} WHERE e > b")

    def year_days_of(cal: str) -> str:
        return (f"SELECT p.member, p.period, count(DISTINCT d.day) AS days FROM pwin p JOIN {cal} d "
                f"ON d.member = p.member AND d.day >= p.w_b AND d.day < p.w_e GROUP BY ALL")

    measures = [("Before", m) for m in ("Prior Service", "Additional Service", "Eligibility", "IP Discharges", "DHS")]
    measures += [("After", m) for m in ("After Service", "IP Admissions")]
    no_loc = ("Eligibility", "DHS")
    blanks = " UNION ALL ".join(
        f"SELECT member, {_q(ba)}, {_q(m)}, NULL, NULL, 0 FROM eps WHERE member NOT IN "
        f"(SELECT member FROM found WHERE Measure_Name = {_q(m)}{'' if m in no_loc else ' AND LOC IS NOT NULL'})"
        for ba, m in measures)
    flags = ""
    if spec.flags:
        flags = (", CASE WHEN a.lasted = 1 THEN 'Yes' ELSE 'No' END AS Flag_BHRS_18plus_Mths_Before_Admission"
                 ", CASE WHEN a.active = 1 THEN 'Yes' ELSE 'No' END AS Flag_Active_DHS_Status")
    drop_rules = [
        "BA_Category = 'Before' AND Measure_Name = 'Prior Service' AND LOC IS NULL",
        "BA_Category = 'Before' AND Measure_Period IS NULL AND LOC IS NULL",
        f"BA_Category = 'After' AND Measure_Name = 'After Service' AND LOC IS NULL "
        f"AND Measure_Period IS NOT DISTINCT FROM '{days} Days'",
        "BA_Category = 'After' AND Measure_Name = 'IP Admissions' AND Measure_Period IS NULL"]
    if adult:
        drop_rules += [
            "BA_Category = 'Before' AND Measure_Name = 'DHS'",
            "BA_Category = 'Before' AND Measure_Name = 'Additional Service' AND coalesce(LOC, '') IN "
            "('(450-1) HOST HOMES - DHS CHILD', '(450-2) HOST HOMES - NON-DHS CHILD')"]
    kept = f"LOS > 0 AND (Days_to_Readmit IS NULL OR Days_to_Readmit >= {spec.min_readmit_days})"
    model_age = f", {_band('Age', spec.age_model[1])} AS {spec.age_model[0]}" if adult else ""
    return [
        ("auth", "SELECT o_orderkey AS auth, o_custkey AS member, CAST(o_orderdate AS DATE) AS sb, "
                 "CASE WHEN o_orderkey % 41 = 0 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 46 AS INTEGER) END AS se, o_orderpriority AS code FROM orders"),
        ("ix", f"SELECT * FROM auth WHERE code IN {codes}"),
        ("idx", f"SELECT member, auth, sb, se, code FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY se, auth) AS rn "
                f"FROM ix WHERE se BETWEEN DATE '{spec.period_begin}' AND DATE '{spec.period_end}') WHERE rn = 1"),
        ("ever", "SELECT i.member, CASE WHEN EXISTS (SELECT 1 FROM ix x WHERE x.member = i.member AND x.sb < i.sb) "
                 "THEN 'N' ELSE 'Y' END AS first_ever FROM idx i"),
        ("readm", f"SELECT member, readmit_auth, readmit_sb FROM (SELECT i.member, x.auth AS readmit_auth, x.sb AS readmit_sb, "
                  f"row_number() OVER (PARTITION BY i.member ORDER BY x.sb, x.auth) AS rn FROM idx i JOIN ix x ON x.member = i.member "
                  f"AND x.auth <> i.auth AND x.sb BETWEEN i.se AND i.se + {days}) WHERE rn = 1"),
        ("eps", f"SELECT i.*, v.first_ever, r.readmit_auth, r.readmit_sb, CAST(r.readmit_sb - i.se AS INTEGER) AS days_to_readmit, "
                f"i.se AS after_b, CASE WHEN r.readmit_sb < i.se + {days} THEN r.readmit_sb ELSE i.se + {days} END AS after_e "
                f"FROM idx i JOIN ever v USING (member) LEFT JOIN readm r USING (member)"),
        ("pwin", f"SELECT member, 'Year ' || y AS period, CAST(y AS INTEGER) AS y, sb - CAST({year} * y AS INTEGER) AS w_b, "
                 f"sb - CAST({year} * (y - 1) AS INTEGER) AS w_e FROM eps, range(1, {spec.prior_years + 1}) t(y)"),
        ("win", f"SELECT member, 'Before' AS ba, period, w_b, w_e FROM pwin UNION ALL "
                f"SELECT member, 'After', '{days} Days', after_b, after_e FROM eps"),
        ("svc", f"SELECT o.o_custkey AS member, CAST(l.l_shipdate AS DATE) AS b, "
                f"CASE WHEN CAST(l.l_quantity AS INTEGER) = 50 THEN DATE '9999-12-31' ELSE CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INTEGER) END AS e, "
                f"l.l_returnflag AS sub, {_CODE} AS code, {_case(_CODE, dict(LOC_GROUPS[spec.age_group]))} AS LOC FROM lineitem l "
                f"JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey"),
        ("extra", spans("4-NOT SPECIFIED", "o_orderkey % 30", f", {additional_loc} AS LOC")),
        ("elig", spans("3-MEDIUM", "60 + o_orderkey % 240")),
        ("dhs", spans("5-LOW", "90", where=" AND o_custkey % 4 = 0")),
        ("bhrs", spans("4-NOT SPECIFIED", "300 + o_orderkey % 600", where=" AND o_custkey % 5 = 0")),
        ("members_in", f"SELECT c_custkey AS member, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender_Label, "
                       f"{_case('c_mktsegment', SEGMENT_RACE)} AS RaceEthnic_Label, "
                       f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST({age} AS INTEGER) END AS Age, "
                       f"CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Y' ELSE 'N' END AS ASD_Measure_Year, "
                       f"CASE WHEN c_custkey % 13 = 0 THEN 'Y' ELSE 'N' END AS ID_Measure_Year, "
                       f"CASE WHEN c_nationkey % 3 = 0 THEN 'SA' ELSE 'MH' END AS MH_SA FROM customer"),
        ("svc_days", "SELECT w.member, w.ba, w.period, s.LOC, s.sub, "
                     "sum(CAST(least(s.e, w.w_e) - greatest(s.b, w.w_b) AS BIGINT)) AS days "
                     "FROM win w JOIN svc s ON s.member = w.member AND s.b < w.w_e AND s.e > w.w_b AND s.e > s.b AND w.w_e > w.w_b GROUP BY ALL"),
        ("add_days", "SELECT p.member, p.period, s.LOC, sum(CAST(least(s.e, p.w_e) - greatest(s.b, p.w_b) AS BIGINT)) AS days "
                     "FROM pwin p JOIN extra s ON s.member = p.member AND s.b < p.w_e AND s.e > p.w_b AND s.e > s.b GROUP BY ALL"),
        ("elig_cal", calendar("elig")),
        ("elig_days", year_days_of("elig_cal")),
        ("dhs_cal", calendar("dhs")),
        ("dhs_days", year_days_of("dhs_cal")),
        ("dcs", "SELECT p.member, p.period, count(*) AS days FROM pwin p JOIN eps USING (member) JOIN ix x ON x.member = p.member "
                "AND x.auth <> eps.auth AND x.se >= p.w_b AND x.se < p.w_e GROUP BY ALL"),
        ("adms", f"SELECT i.member, count(*) AS days FROM idx i JOIN ix x ON x.member = i.member AND x.auth <> i.auth "
                 f"AND x.sb BETWEEN i.se AND i.se + {days} GROUP BY ALL"),
        ("atadm", "SELECT i.member, coalesce((SELECT max(1) FROM dhs d WHERE d.member = i.member AND d.b <= i.sb AND d.e > i.sb), 0) AS active, "
                  "coalesce((SELECT max(1) FROM bhrs d WHERE d.member = i.member AND d.b < i.sb "
                  "AND CAST(d.b + INTERVAL 18 MONTH AS DATE) <= least(d.e, i.sb)), 0) AS lasted FROM idx i"),
        ("found", "SELECT member, ba AS BA_Category, CASE ba WHEN 'After' THEN 'After Service' ELSE 'Prior Service' END AS Measure_Name, "
                  "period AS Measure_Period, LOC, days AS Day_Count FROM svc_days "
                  "UNION ALL SELECT member, 'Before', 'Additional Service', period, LOC, days FROM add_days "
                  "UNION ALL SELECT member, 'Before', 'Eligibility', period, NULL, days FROM elig_days "
                  "UNION ALL SELECT member, 'Before', 'DHS', period, NULL, days FROM dhs_days "
                  "UNION ALL SELECT member, 'Before', 'IP Discharges', period, 'IP', days FROM dcs "
                  f"UNION ALL SELECT member, 'After', 'IP Admissions', '{days} Days', 'IP', days FROM adms"),
        ("lines", f"SELECT * FROM found UNION ALL {blanks}"),
        ("extract", f"SELECT CAST(e.auth AS VARCHAR) AS AuthorizationNumber, CAST(e.member AS VARCHAR) AS Client_Master_BK, "
                    f"e.sb AS ServiceBegin, e.se AS ServiceEnd, m.Gender_Label, m.RaceEthnic_Label, m.Age, m.ASD_Measure_Year, "
                    f"m.ID_Measure_Year, {_case('e.code', dict(spec.loc_labels))} AS LOC_Label, e.first_ever AS FirstEpEver, m.MH_SA, "
                    f"CAST(CASE WHEN e.readmit_auth <> 0 THEN e.readmit_auth END AS VARCHAR) AS Readmit_Auth, e.readmit_sb AS Readmit_SB, "
                    f"e.days_to_readmit AS Days_to_Readmit{flags}, l.BA_Category, l.Measure_Name, l.Measure_Period, l.LOC, "
                    f"CAST(l.Day_Count AS BIGINT) AS Day_Count FROM eps e JOIN lines l USING (member) "
                    f"LEFT JOIN members_in m USING (member) LEFT JOIN atadm a USING (member)"),
        ("started", f"SELECT *, CAST(ServiceEnd - ServiceBegin AS INTEGER) AS LOS, CASE WHEN Readmit_Auth IS NULL THEN 'No' ELSE 'Yes' END AS Flag_Readmit, "
                    f"{_case('RaceEthnic_Label', RACE_MAP)} AS RaceCat, {_band('Age', spec.age_cat)} AS AgeCat{model_age}, "
                    f"coalesce(Days_to_Readmit, {days}) AS SurvivalDays FROM extract"),
        ("tidy", f"SELECT * FROM started WHERE {kept} " + " ".join(f"AND NOT ({rule})" for rule in drop_rules)),
        ("people", "SELECT DISTINCT * EXCLUDE (BA_Category, Measure_Name, Measure_Period, LOC, Day_Count, RaceEthnic_Label) FROM tidy"),
    ]


def _sql(spec: RunSpec, final: str, extra: list[tuple[str, str]] = ()) -> str:
    relations = [*_base(spec), *extra]
    body = ",\n".join(f"{name} AS ({text})" for name, text in relations)
    return f"WITH {body}\n{final}"


# ---- wide and model tables -------------------------------------------------------------------------------

def _wide(spec: RunSpec) -> tuple[str, list[str]]:
    cols: list[tuple[str, str]] = []

    def add(name: str, ba: str, measure: str, period: str, loc: str | None):
        where = f"BA_Category = {_q(ba)} AND Measure_Name = {_q(measure)} AND Measure_Period = {_q(period)} AND " + (
            "LOC IS NULL" if loc is None else f"LOC = {_q(loc)}")
        cols.append((name, f'CAST(sum(Day_Count) FILTER (WHERE {where}) AS BIGINT) AS "{name}"'))

    for loc, short in spec.service_groups:
        add(f"After_{short}", "After", "After Service", spec.after_period, loc)
    add("N_AIPAdmits_1YrAfter", "After", "IP Admissions", spec.after_period, "IP")
    for y in spec.years:
        period = f"Year {y}"
        for loc, short in spec.additional_groups:
            add(f"Yr{y}Prior_{short}", "Before", "Additional Service", period, loc)
        if spec.name == "child":
            add(f"Yr{y}Prior_DHS", "Before", "DHS", period, None)
        add(f"Yr{y}Prior_Elig", "Before", "Eligibility", period, None)
        add(f"N_AIPDC_{y}YrPrior", "Before", "IP Discharges", period, "IP")
        for loc, short in spec.service_groups:
            add(f"Yr{y}Prior_{short}", "Before", "Prior Service", period, loc)
    sums = ", ".join(text for _, text in cols)
    return (f"SELECT w.*, p.* EXCLUDE (Client_Master_BK) FROM people p "
            f"JOIN (SELECT Client_Master_BK, {sums} FROM tidy GROUP BY Client_Master_BK) w USING (Client_Master_BK)",
            [name for name, _ in cols])


def _wide_cte(spec: RunSpec) -> list[tuple[str, str]]:
    return [("wide", _wide(spec)[0])]


def _model(spec: RunSpec) -> str:
    cols = _wide(spec)[1]
    used = [c for c in cols if c.startswith(("After_", "Yr1Prior_")) and c != "Yr1Prior_Elig"
            and not c.endswith(tuple(short for _, short in spec.additional_groups))]
    flags = ", ".join(f'CASE WHEN "{c}" IS NULL THEN \'No\' ELSE \'Yes\' END AS "{c}"' for c in used)
    extra = ""
    if spec.name == "child":
        extra = (f", {_band('Age', spec.age_model[1])} AS {spec.age_model[0]}"
                 f", {_asdid()} AS ASDID, CASE WHEN LOC_Label = {_q(spec.voluntary_label)} THEN 'Voluntary' "
                 f"WHEN LOC_Label IS NOT NULL THEN 'Involuntary' END AS Voluntary")
    keep = ["Client_Master_BK", "ServiceBegin", "ServiceEnd", "Gender_Label", "Age", "FirstEpEver", "MH_SA", "Days_to_Readmit",
            "LOS", "RaceCat", "AgeCat", "SurvivalDays", *spec.flags]
    if spec.name == "adult":
        keep.append(spec.age_model[0])
    return (f"SELECT {', '.join(keep)}, {flags}, CASE WHEN N_AIPDC_1YrPrior IS NULL THEN 'No' ELSE 'Yes' END AS Yr1Prior_AnyAIP, "
            f"{_band('LOS', spec.los_cat)} AS LOScat, {_band('Yr1Prior_Elig', spec.elig_cat)} AS eligcat, "
            f"CASE Flag_Readmit WHEN 'Yes' THEN 1 ELSE 0 END AS Flag_Readmit{extra} FROM wide")


def _asdid() -> str:
    return ("CASE WHEN ASD_Measure_Year = 'Y' OR ID_Measure_Year = 'Y' THEN 'ASD or ID' "
            "WHEN ASD_Measure_Year IS NULL OR ID_Measure_Year IS NULL THEN NULL ELSE 'No ASD or ID' END")


# ---- cohort ---------------------------------------------------------------------------------------------

def _year_pivot(source: str, keys: str, spec: RunSpec, where: str = "") -> str:
    cols = ", ".join(f"CAST(coalesce(sum(days) FILTER (WHERE period = 'Year {y}'), 0) AS BIGINT) AS y{y}" for y in spec.years)
    return f"SELECT {keys}, {cols} FROM {source} {where} GROUP BY {keys}"


def _lookback_spans(source: str, keys: str, spec: RunSpec) -> str:
    return (f"SELECT DISTINCT {keys} FROM {source} s JOIN eps ON eps.member = s.member WHERE s.b < eps.sb AND s.e > eps.sb - "
            f"{spec.year_days * spec.prior_years}")


_LINE_COLS = ("AuthorizationNumber, Client_Master_BK, ServiceBegin, ServiceEnd, Gender_Label, RaceEthnic_Label, Age, ASD_Measure_Year, "
              "ID_Measure_Year, LOC_Label, FirstEpEver, MH_SA, Readmit_Auth, Readmit_SB, Days_to_Readmit, BA_Category, Measure_Name, "
              "Measure_Period, LOC, Day_Count")


def _cohort() -> dict[str, str]:
    a, c = ADULT, CHILD
    out = {
        "index_episodes": _sql(a, "SELECT * FROM idx"),
        "first_episode_ever": _sql(a, "SELECT * FROM ever"),
        "readmission_windows": _sql(a, "SELECT member, auth, sb, se, readmit_auth, readmit_sb, days_to_readmit, after_b, after_e FROM eps"),
        "prior_windows": _sql(a, "SELECT member, period AS Measure_Period, w_b, w_e FROM pwin"),
        "member_attributes": _sql(a, "SELECT m.* FROM idx JOIN members_in m USING (member)"),
        "merged_eligibility": _sql(a, """
            SELECT member, min(day) AS b, nullif(max(day) + 1, DATE '2003-01-01') AS e FROM (
                SELECT member, day, day - CAST(row_number() OVER (PARTITION BY member ORDER BY day) AS INTEGER) AS run
                FROM (SELECT DISTINCT member, day FROM elig_cal)) GROUP BY member, run"""),
        "ip_counts": _sql(a, f"""
            SELECT i.member, CAST(count(*) FILTER (WHERE x.sb BETWEEN i.se AND i.se + 180) AS BIGINT) AS n_adm,
            {', '.join(f'CAST(count(*) FILTER (WHERE x.se >= i.sb - {365 * y} AND x.se < i.sb - {365 * (y - 1)}) AS BIGINT) AS n_dc_{y}'
                       for y in a.years)}
            FROM idx i JOIN ix x ON x.member = i.member AND x.auth <> i.auth AND x.sb <= i.se + 180 AND x.se >= i.sb - {365 * 3}
            GROUP BY i.member"""),
        "eligibility_days": _sql(a, _year_pivot("elig_days", "member", a)),
        "dhs_days": _sql(c, _year_pivot("dhs_days", "member", c)),
        "admission_flags": _sql(c, "SELECT member, lasted, active FROM atadm"),
        "extract_csv_round_trip": _sql(a, f"SELECT {_LINE_COLS} FROM extract"),
        "readmission_overview": _sql(a, f"""
            SELECT Gender_Label, count(*) AS n, count(readmit_auth) AS n_readmit,
            {_r('count(readmit_auth) / count(*) * 100', 'percent_readmit')}, {_summary('LOS', 'LOS')},
            (SELECT los FROM (SELECT se - sb AS los, count(*) AS k FROM eps e2 JOIN members_in m2 USING (member)
             WHERE m2.Gender_Label IS NOT DISTINCT FROM g.Gender_Label AND se > sb GROUP BY 1 ORDER BY k DESC, los LIMIT 1)) AS ModeLOS
            FROM (SELECT m.Gender_Label, CAST(se - sb AS INTEGER) AS LOS, readmit_auth FROM eps JOIN members_in m USING (member) WHERE se > sb) g
            GROUP BY Gender_Label"""),
    }
    for name, spec in {"adult": a, "child": c}.items():
        out[f"loc_grouping_{name}"] = _sql(spec, "SELECT code, LOC, count(*) AS n_lines FROM svc GROUP BY ALL")
        years = ", ".join(f"CAST(coalesce(sum(days) FILTER (WHERE period = 'Year {y}'), 0) AS BIGINT) AS y{y}" for y in spec.years)
        out[f"service_days_{name}"] = _sql(spec, f"""
            SELECT k.member, k.LOC, k.sub, CAST(coalesce(sum(days) FILTER (WHERE period = '{spec.after_period}'), 0) AS BIGINT) AS after, {years}
            FROM (SELECT DISTINCT s.member, s.LOC, s.sub FROM svc s JOIN eps ON eps.member = s.member
                  WHERE s.b < eps.after_e AND s.e > eps.sb - {spec.year_days * spec.prior_years}) k
            LEFT JOIN svc_days d ON d.member = k.member AND d.LOC IS NOT DISTINCT FROM k.LOC AND d.sub = k.sub
            GROUP BY k.member, k.LOC, k.sub""")
        back = f"s.e > eps.sb - {spec.year_days * spec.prior_years}"
        kinds = {"service": ("svc", "s.LOC, s.sub", f"s.b < eps.after_e AND {back}"), "additional": ("extra", "s.LOC, NULL", f"s.b < eps.sb AND {back}"),
                 "eligibility": ("elig", "NULL, NULL", f"s.b < eps.sb AND {back}"), "dhs": ("dhs", "NULL, NULL", f"s.b <= eps.sb AND {back}"),
                 "bhrs": ("bhrs", "NULL, NULL", "s.b < eps.sb")}
        keys = " UNION ALL ".join(f"SELECT DISTINCT s.member, '{k}', {cols} FROM {source} s JOIN eps ON eps.member = s.member WHERE {near}"
                                  for k, (source, cols, near) in kinds.items())
        out[f"span_days_{name}"] = _sql(spec, f"""
            SELECT k.member, k.kind, k.LOC, k.sub, CAST(coalesce(sum(days) FILTER (WHERE period = '{spec.after_period}'), 0) AS BIGINT) AS after, {years},
                   max(CASE WHEN k.kind = 'dhs' THEN a.active ELSE 0 END) AS active, max(CASE WHEN k.kind = 'bhrs' THEN a.lasted ELSE 0 END) AS lasted
            FROM k JOIN atadm a USING (member) LEFT JOIN d ON d.member = k.member AND d.kind = k.kind AND d.LOC IS NOT DISTINCT FROM k.LOC
                 AND d.sub IS NOT DISTINCT FROM k.sub
            GROUP BY k.member, k.kind, k.LOC, k.sub""", [
            ("k(member, kind, LOC, sub)", keys),
            ("d", "SELECT member, 'service' AS kind, LOC, sub, period, days FROM svc_days UNION ALL SELECT member, 'additional', LOC, NULL, period, days FROM add_days "
                  "UNION ALL SELECT member, 'eligibility', NULL, NULL, period, days FROM elig_days UNION ALL SELECT member, 'dhs', NULL, NULL, period, days FROM dhs_days")])
        out[f"additional_days_{name}"] = _sql(spec, f"""
            SELECT k.member, k.LOC, {years} FROM ({_lookback_spans('extra', 's.member, s.LOC', spec)}) k
            LEFT JOIN add_days d ON d.member = k.member AND d.LOC = k.LOC GROUP BY k.member, k.LOC""")
        out[f"extract_{name}"] = _sql(spec, f"SELECT {_LINE_COLS} FROM extract")
        out[f"guessed_types_{name}"] = _sql(spec, _guessed())
    return out


def _guessed() -> str:
    """Types of the delivered columns from their texts. A missing readmission is delivered as NA, an unknown unused column is empty."""
    columns = ["AuthorizationNumber", "Client_Master_BK", "ServiceBegin", "Gender_Label", "Age", "ASD_Measure_Year", "LOC_Label", "Readmit_SB",
               "Days_to_Readmit", "Measure_Period", "LOC", "Day_Count"]
    text = lambda c: f"strftime({c}, '%m/%d/%Y')" if c in ("ServiceBegin", "Readmit_SB") else f"CAST({c} AS VARCHAR)"
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, {text(c)} AS cell FROM extract" for c in columns)
    whole, day = "regexp_full_match(cell, '[+-]?[0-9]+')", "try_strptime(cell, '%m/%d/%Y') IS NOT NULL"
    return (f"SELECT col AS \"column\", CASE WHEN count(cell) = 0 THEN 'string' WHEN bool_and({whole}) AND max(try_cast(cell AS BIGINT)) < 2147483648 THEN 'int' "
            f"WHEN bool_and({whole}) THEN 'bigint' WHEN bool_and(cell IS NULL OR try_cast(cell AS DOUBLE) IS NOT NULL) THEN 'double' WHEN bool_and(cell IS NULL OR {day}) THEN 'date' ELSE 'string' END AS type, "
            f"count(cell) AS n, count(*) - count(cell) AS n_missing, count(*) FILTER (WHERE NOT ({whole})) AS not_int, "
            f"count(cell) - count(*) FILTER (WHERE cell IS NOT NULL AND {day}) AS not_date FROM ({cells}) GROUP BY col "
            f"UNION ALL SELECT 'Ep180', 'string', 0, count(*), 0, 0 FROM extract")


# ---- cleaning -------------------------------------------------------------------------------------------

def _cleaning() -> dict[str, str]:
    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        flags = "".join(f", {f}" for f in spec.flags)
        audit_steps = [("quality", f"LOS > 0 AND (Days_to_Readmit IS NULL OR Days_to_Readmit >= {spec.min_readmit_days})"),
                       ("ungrouped prior service", "NOT (Measure_Name = 'Prior Service' AND LOC IS NULL)"),
                       ("empty before line", "NOT (BA_Category = 'Before' AND Measure_Period IS NULL AND LOC IS NULL)"),
                       ("ungrouped after service", "NOT (Measure_Name = 'After Service' AND LOC IS NULL AND Measure_Period IS NOT NULL)"),
                       ("empty admission line", "NOT (Measure_Name = 'IP Admissions' AND Measure_Period IS NULL)")]
        if name == "adult":
            audit_steps += [("DHS line", "Measure_Name <> 'DHS'"),
                            ("host home line", "NOT (Measure_Name = 'Additional Service' AND LOC IS NOT NULL AND LOC LIKE '(450-_) HOST HOMES%')")]
        parts = []
        for i, (step, _) in enumerate(audit_steps, 1):
            before = " AND ".join(["TRUE", *[f"({p})" for _, p in audit_steps[:i - 1]]])
            upto = " AND ".join(f"({p})" for _, p in audit_steps[:i])
            parts.append(f"SELECT {i} AS step_no, {_q(step)} AS step, count(*) FILTER (WHERE {before}) AS rows_in, "
                         f"count(*) FILTER (WHERE ({before}) AND NOT ({upto})) AS rows_removed, "
                         f"count(*) FILTER (WHERE {upto}) AS rows_out FROM started")
        levels = " UNION ALL ".join(
            f"SELECT '{c}' AS variable, {c} AS level, count(*) AS n FROM tidy GROUP BY {c}"
            for c in ("Measure_Name", "Measure_Period", "LOC", "FirstEpEver", "Flag_Readmit"))
        out |= {
            f"starting_point_{name}": _sql(spec, "SELECT LOS, Flag_Readmit, RaceCat, AgeCat, SurvivalDays, count(*) AS n_lines FROM started GROUP BY ALL"),
            f"clean_long_{name}": _sql(spec, f"SELECT Client_Master_BK, {DIMS}, Day_Count, LOS, SurvivalDays, Flag_Readmit{flags} FROM tidy"),
            f"member_table_{name}": _sql(spec, "SELECT * FROM people"),
            f"stage_audit_{name}": _sql(spec, " UNION ALL ".join(parts)),
            f"first_appearance_{name}": _sql(spec, " UNION ALL ".join(
                f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, row_number() OVER (ORDER BY "
                f"min({{'a': CAST(AuthorizationNumber AS BIGINT), 'm': CAST(Client_Master_BK AS BIGINT)}})) AS level_no FROM people WHERE {c} IS NOT NULL GROUP BY {c}"
                for c in ("RaceCat", "AgeCat", "LOC_Label", "MH_SA", "LOS"))),
            f"quality_checks_{name}": _sql(spec, f"""
                SELECT count(*) FILTER (WHERE Days_to_Readmit < {spec.quick_readmit_below}) AS quick_readmits,
                count(*) FILTER (WHERE LOS = 0) AS short_stays FROM (SELECT DISTINCT * EXCLUDE ({DIMS}, Day_Count, RaceEthnic_Label) FROM started)"""),
            f"level_list_{name}": _sql(spec, levels),
            f"table_sizes_{name}": _sql(spec, "SELECT count(*) AS n_rows, count(DISTINCT Client_Master_BK) AS n_members FROM tidy"),
            f"estimated_members_{name}": _sql(spec, "SELECT BA_Category, Measure_Name, count(*) AS n_rows, "
                                              "count(DISTINCT Client_Master_BK) AS n_members, TRUE AS within_bound FROM tidy GROUP BY ALL"),
        }
    out["age_level_order"] = _sql(ADULT, f"SELECT DISTINCT AgeCat, {_level('AgeCat', ADULT.age_cat.labels)} AS AgeCat_key FROM people")
    return out


# ---- description ------------------------------------------------------------------------------------------

def _freq(col: str, source: str = "people", levels=None, more: str = "") -> str:
    order = f"{_level(col, levels)}, {col}" if levels else f"n DESC, {col} ASC NULLS LAST"
    return (f"SELECT {col}, n, {_r('n / sum(n) OVER () * 100', 'percent')}, row_number() OVER (ORDER BY {order}) AS display_rank{more} "
            f"FROM (SELECT {col}, count(*) AS n FROM {source} GROUP BY {col})")


def _summary(value: str, suffix: str) -> str:
    return (f"{_r(f'avg({value})', f'Avg{suffix}')}, {_r(f'quantile_cont({value}, 0.5)', f'Med{suffix}')}, "
            f"{_r(f'stddev_samp({value})', f'SD{suffix}')}, "
            f"{_r(f'quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)', f'IQR{suffix}')}, "
            f"min({value}) AS min{suffix}, max({value}) AS max{suffix}")


def _num_summary(value: str, suffix: str, by: str | None, where: str = "TRUE") -> str:
    group = f"{by}, " if by else ""
    match = f"p.{by} IS NOT DISTINCT FROM g.{by} AND " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    src = f"(SELECT {group}{value} FROM people WHERE {where})"
    mode = (f"SELECT {group}{value} AS Mode{suffix} FROM (SELECT {group}{value}, row_number() OVER "
            f"({'PARTITION BY ' + by if by else ''} ORDER BY k DESC, {value}) AS rn FROM "
            f"(SELECT {group}{value}, count(*) AS k FROM {src} GROUP BY ALL)) WHERE rn = 1")
    joined = f"ON {match}TRUE"
    keys = f"g.{by}, " if by else ""
    return (f"SELECT {keys}g.* {'EXCLUDE (' + by + ')' if by else ''}, p.Mode{suffix} FROM "
            f"(SELECT {group}{_summary(value, suffix)} FROM {src} {tail}) g JOIN ({mode}) p {joined}")


def _stacked(sections: list[tuple[str, str, list[str] | None]], name: str) -> str:
    parts = []
    for i, (title, expr, levels) in enumerate(sections, 1):
        order = f"{_level('v', levels)}, " if levels else ""
        parts.append(
            f"SELECT {i} AS section_no, {_q(title)} AS section, v AS {name}, n, "
            f"CAST(round_even(n / sum(n) OVER () * 100, 1) AS DOUBLE) AS percent, "
            f"row_number() OVER (ORDER BY {order}n DESC, v ASC NULLS LAST) AS display_rank "
            f"FROM (SELECT {expr} AS v, count(*) AS n FROM people GROUP BY 1)")
    return " UNION ALL ".join(parts)


def _demographics(spec: RunSpec) -> str:
    sections = [("Gender", "Gender_Label", spec.gender_levels), ("Age at Admission", "AgeCat", spec.age_cat.labels),
                ("Race", "RaceCat", None), ("Does member have SA hx", "CASE MH_SA WHEN 'MH' THEN 'No' WHEN 'SA' THEN 'Yes' ELSE MH_SA END", None)]
    if spec.name == "child":
        sections += [("ASD diagnosis", "CASE ASD_Measure_Year WHEN 'N' THEN 'No ASD' WHEN 'Y' THEN 'ASD Dx' END", None),
                     ("ID diagnosis", "CASE ID_Measure_Year WHEN 'N' THEN 'No ID' WHEN 'Y' THEN 'ID Dx' END", None)]
    return _stacked([*sections, ("Does member have ASD and/or ID diagnosis", _asdid(), None)], "Demos")


def _history(spec: RunSpec) -> str:
    sections = [("Is this the member's first AIP episode", "CASE FirstEpEver WHEN 'N' THEN 'Had an earlier AIP episode' WHEN 'Y' THEN 'First AIP ever' END", None)]
    if spec.flags:
        sections += [("Is member DHS involved at time of Index Episode",
                      "CASE Flag_Active_DHS_Status WHEN 'No' THEN 'No DHS during AIP' ELSE 'DHS during AIP' END", None),
                     ("Member's BHRS history at time of Index Episode",
                      "CASE Flag_BHRS_18plus_Mths_Before_Admission WHEN 'No' THEN 'Does not have BHRS episode >= 18 months' "
                      "ELSE 'Has BHRS episode >= 18 months' END", None)]
    sections.append(("Does member readmit to AIP within 180 days",
                     "CASE Flag_Readmit WHEN 'No' THEN 'No Readmit' ELSE 'Readmit within 180' END", None))
    return _stacked(sections, "ServUtil")


def _los_table() -> str:
    def row(no: int, label: str, value: str, where: str) -> str:
        even = lambda e, n: f"CAST(round_even({e}, 1) AS DOUBLE) AS {n}"
        return (f"SELECT {no} AS row_no, '{label}' AS Measure, {even(f'avg({value})', 'AvgDays')}, "
                f"{even(f'quantile_cont({value}, 0.5)', 'MedDays')}, {even(f'stddev_samp({value})', 'SDDays')}, "
                f"{even(f'quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)', 'IQRDays')}, "
                f"min({value}) AS minDays, max({value}) AS maxDays FROM people WHERE {where}")
    return " UNION ALL ".join([
        row(1, "Overall LOS", "LOS", "TRUE"),
        row(2, "LOS for those that did not readmit", "LOS", "Flag_Readmit = 'No'"),
        row(3, "LOS for those that did readmit", "LOS", "Flag_Readmit = 'Yes'"),
        row(4, "Days to Readmission", "Days_to_Readmit", "Days_to_Readmit IS NOT NULL")])


def _box(source: str, value: str, by: list[str]) -> str:
    keys = ", ".join(by) if by else "'all'"
    group = f"GROUP BY {keys}" if by else ""
    pick = f"{keys}, " if by else ""
    match = " AND ".join(f"r.{c} IS NOT DISTINCT FROM q.{c}" for c in by) or "TRUE"
    out = "".join(f"q.{c}, " for c in by)
    v, low, high = f"round(r.{value}, 9)", "round(q.q1 - 1.5 * (q.q3 - q.q1), 9)", "round(q.q3 + 1.5 * (q.q3 - q.q1), 9)"
    inside = f"{v} BETWEEN {low} AND {high}"
    outgroup = "".join(f"q.{c}, " for c in by)
    notch = "1.58 * (q.q3 - q.q1) / sqrt(q.n)"
    return f"""
        SELECT {out}q.n, {_r('q.mean', 'mean')}, {_r(f'min(r.{value}) FILTER (WHERE {inside})', 'lower_whisker')}, {_r('q.q1', 'q1')}, {_r('q.median', 'median')},
        {_r('q.q3', 'q3')}, {_r(f'max(r.{value}) FILTER (WHERE {inside})', 'upper_whisker')},
        CAST(count(*) FILTER (WHERE NOT ({inside})) AS BIGINT) AS n_outliers,
        {_r(f'q.median - {notch}', 'notch_low')}, {_r(f'q.median + {notch}', 'notch_high')}
        FROM (SELECT {pick}CAST(count(*) AS BIGINT) AS n, avg({value}) AS mean, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
              quantile_cont({value}, 0.75) AS q3 FROM {source} WHERE {value} IS NOT NULL {group}) q
        JOIN {source} r ON {match} WHERE r.{value} IS NOT NULL GROUP BY {outgroup}q.n, q.mean, q.q1, q.median, q.q3"""


def _box_by_loc(source: str, value: str, by: list[str]) -> str:
    rank = f"SELECT LOC, row_number() OVER (ORDER BY round(avg({value}), 9) DESC, LOC) AS display_rank FROM {source} WHERE {value} IS NOT NULL GROUP BY LOC"
    return f"SELECT b.*, o.display_rank FROM ({_box(source, value, ['LOC', *by])}) b JOIN ({rank}) o USING (LOC)"


def _hist(col: str, width: int, bins: int) -> str:
    parts = []
    for i in range(bins + 2):
        lo, hi = (width * (i - 1) if i else None), (width * i if i <= bins else None)
        rule = f"{col} < 0" if i == 0 else f"{col} {'>=' if i == 1 else '>'} {lo}" + (f" AND {col} <= {hi}" if i <= bins else "")
        text = ["NULL" if x is None else x for x in (lo, hi)]
        parts.append(f"SELECT {i} AS bin, CAST({text[0]} AS DOUBLE) AS lo, CAST({text[1]} AS DOUBLE) AS hi, count(*) FILTER (WHERE {rule}) AS n FROM wide")
    return " UNION ALL ".join(parts)


def _facts(spec: RunSpec, unknown_too: bool = False) -> str:
    pct = lambda cond: f"count(*) FILTER (WHERE ({cond}){' IS NOT FALSE' if unknown_too else ''}) / count(*) * 100"
    yes = "Flag_Readmit = 'Yes'"
    facts = {
        "members": "count(*)", "pct_male": pct("Gender_Label = 'Male'"), "pct_female": pct("Gender_Label = 'Female'"),
        "mean_age": "avg(Age)", "median_age": "quantile_cont(Age, 0.5)", "pct_white": pct("RaceCat = 'White'"),
        "pct_black": pct("RaceCat = 'Black'"), "pct_hispanic": pct("RaceCat = 'Hispanic'"), "pct_asd": pct("ASD_Measure_Year = 'Y'"),
        "pct_id": pct("ID_Measure_Year = 'Y'"), "pct_sa": pct("MH_SA = 'SA'"),
        "pct_voluntary": pct(f"LOC_Label = {_q(spec.voluntary_label)}"), "pct_first_ever": pct("FirstEpEver = 'Y'"),
        "median_los": "quantile_cont(LOS, 0.5)", "mean_los": "avg(LOS)", "min_los": "min(LOS)", "max_los": "max(LOS)",
        "max_survival_days": "max(SurvivalDays)", "pct_readmit": pct(yes), "pct_readmit_30": pct(f"{yes} AND SurvivalDays <= 30"),
        "pct_readmit_60": pct(f"{yes} AND SurvivalDays <= 60"), "mean_days_to_readmit": "avg(Days_to_Readmit)",
        "pct_of_readmits_30": f"count(*) FILTER (WHERE {yes} AND Days_to_Readmit <= 30) * 100.0 / count(*) FILTER (WHERE {yes})",
    }
    if spec.name == "adult":
        facts["pct_age_30_or_less"] = pct("Age <= 30")
    else:
        facts |= {"pct_age_14_up": pct("Age >= 14"), "pct_dhs_now": pct("Flag_Active_DHS_Status = 'Yes'"),
                  "pct_dhs_prior_year": pct("Yr1Prior_DHS IS NOT NULL")}
    return " UNION ALL ".join(f"SELECT '{k}' AS fact, {_r(v, 'value')} FROM wide" for k, v in facts.items())


def _profile(texts: list[str], numbers: list[str]) -> str:
    parts = []
    for c in [*texts, *numbers]:
        stats = (", ".join([_r(f"avg({c})", "mean"), _r(f"stddev_samp({c})", "sd"), *[
            _r(f"quantile_cont({c}, {p / 100})", f"p{p}") for p in (0, 25, 50, 75, 100)]]) if c in numbers else
            ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "sd", "p0", "p25", "p50", "p75", "p100")))
        top = (f"SELECT string_agg(v || ': ' || k, ', ' ORDER BY k DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM people "
               f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 4)")
        parts.append(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique, "
                     f"({top}) AS top_counts, {stats} FROM people")
    return " UNION ALL ".join(parts)


def _share(expr: str, name: str, digits: int | None) -> str:
    share = "n / sum(n) OVER ()"
    value = _r(share, "perc") if digits is None else f"CAST(round_even({share} * 100, {digits}) AS DOUBLE) AS perc"
    return f"SELECT {name}, n, {value} FROM (SELECT {expr} AS {name}, count(*) AS n FROM wide GROUP BY 1)"


def _description() -> dict[str, str]:
    out = {}
    dims = {"gender": "Gender_Label", "age": "AgeCat", "race": "RaceCat", "mh_sa": "MH_SA", "first_episode": "FirstEpEver",
            "readmit": "Flag_Readmit", "asd": "ASD_Measure_Year", "id": "ID_Measure_Year"}
    flags = {"bhrs": "Flag_BHRS_18plus_Mths_Before_Admission", "dhs": "Flag_Active_DHS_Status"}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        wide = _wide_cte(spec)
        for key, col in (dims | (flags if spec.flags else {})).items():
            levels = {"gender": spec.gender_levels, "age": spec.age_cat.labels}.get(key)
            out[f"freq_{key}_{name}"] = _sql(spec, _freq(col, levels=levels))
        out[f"freq_loc_{name}"] = _sql(spec, _freq("LOC_Label", more=", split_part(LOC_Label, ' ', 1) AS LOC"))
        out[f"freq_asd_or_id_{name}"] = _sql(spec, _freq("ASDID", source=f"(SELECT {_asdid()} AS ASDID FROM people)"))
        texts = ["Gender_Label", "RaceCat", "AgeCat", "MH_SA", "FirstEpEver", "LOC_Label", "ASD_Measure_Year", "Client_Master_BK"]
        out |= {
            f"los_by_readmit_{name}": _sql(spec, _num_summary("LOS", "LOS", "Flag_Readmit")),
            f"los_overall_{name}": _sql(spec, _num_summary("LOS", "LOS", None)),
            f"days_to_readmit_{name}": _sql(spec, _num_summary("Days_to_Readmit", "DTR", "Flag_Readmit", "Days_to_Readmit IS NOT NULL")),
            f"demographics_table_{name}": _sql(spec, _demographics(spec)),
            f"service_history_table_{name}": _sql(spec, _history(spec)),
            f"los_readmit_table_{name}": _sql(spec, _los_table()),
            f"fast_facts_{name}": _sql(spec, _facts(spec), wide),
            f"fast_facts_na_rows_{name}": _sql(spec, _facts(spec, True), wide),
            f"readmit_timing_{name}": _sql(spec, f"""
                SELECT Readmit_Cat, Week_Cat, n, {_r('n / sum(n) OVER ()', 'perc')} FROM (SELECT {_band('Days_to_Readmit', MONTH_BANDS)} AS Readmit_Cat,
                {_band('Days_to_Readmit', WEEK_BANDS)} AS Week_Cat, count(*) AS n FROM wide WHERE Flag_Readmit = 'Yes' GROUP BY 1, 2)""", wide),
            f"profile_{name}": _sql(spec, _profile(texts, ["Age", "LOS", "Days_to_Readmit", "SurvivalDays"])),
            f"los_share_{name}": _sql(spec, _share(_band("LOS", spec.los_cat), "LOScat", 2), wide),
            f"eligibility_share_{name}": _sql(spec, _share(_band("Yr1Prior_Elig", spec.elig_explore), "eligcat", None), wide),
            f"value_counts_los_{name}": _sql(spec, "SELECT LOS, count(*) AS n FROM wide WHERE LOS IS NOT NULL GROUP BY 1", wide),
            f"value_counts_age_{name}": _sql(spec, "SELECT Age, count(*) AS n FROM wide WHERE Age IS NOT NULL GROUP BY 1", wide),
            f"value_counts_ip_{name}": _sql(spec, "SELECT N_AIPDC_1YrPrior, count(*) AS n FROM wide WHERE N_AIPDC_1YrPrior IS NOT NULL GROUP BY 1", wide),
            f"hist_eligibility_{name}": _sql(spec, _hist("Yr1Prior_Elig", 200, 2), wide),
            f"box_los_overall_{name}": _sql(spec, _box("people", "LOS", [])),
        }
        own = {"asd": "ASD_Measure_Year", "dhs": "Flag_Active_DHS_Status"} if spec.flags else {}
        for key, col in {"readmit": "Flag_Readmit", "gender": "Gender_Label", "race": "RaceCat", "age": "AgeCat",
                         "first_episode": "FirstEpEver", **own}.items():
            out[f"box_los_{key}_{name}"] = _sql(spec, _box("people", "LOS", [col]))
            if key != "first_episode":
                out[f"box_days_to_readmit_{key}_{name}"] = _sql(spec, _box("people", "Days_to_Readmit", [col]))
    out["percent_labels_adult"] = _sql(ADULT, f"""
        SELECT Readmit_Cat, Week_Cat, printf('%.1f%%', round_even(n / sum(n) OVER (), 3) * 100) AS label FROM (
        SELECT {_band('Days_to_Readmit', MONTH_BANDS)} AS Readmit_Cat, {_band('Days_to_Readmit', WEEK_BANDS)} AS Week_Cat, count(*) AS n
        FROM wide WHERE Flag_Readmit = 'Yes' GROUP BY 1, 2)""", _wide_cte(ADULT))
    out["box_los_age2_adult"] = _sql(ADULT, _box("people", "LOS", ["AgeCat2"]))
    for width, bins in ((7, 42), (10, 30)):
        out[f"hist_los_{width}_child"] = _sql(CHILD, _hist("LOS", width, bins), _wide_cte(CHILD))
    return out


# ---- utilization ------------------------------------------------------------------------------------------

def _utilization() -> dict[str, str]:
    out = {}
    n_members = "(SELECT count(DISTINCT Client_Master_BK) FROM people)"
    n_rows = "(SELECT count(*) FROM people)"
    n_long = "(SELECT count(*) FROM tidy)"
    perc = lambda d: _r(f"count(*) / {d} * 100", "Perc_UsingService")
    rank = lambda by, key="LOC": f"row_number() OVER (ORDER BY {by} DESC NULLS LAST, {key} ASC NULLS LAST) AS display_rank"

    def days(keys: str, where: str, name: str = "Days") -> str:
        return f"SELECT Client_Master_BK, {keys}, {_strict('Day_Count')} AS {name} FROM tidy WHERE {where} GROUP BY Client_Master_BK, {keys}"

    after = "BA_Category = 'After' AND Measure_Name = 'After Service'"
    prior = "BA_Category = 'Before' AND Measure_Name = 'Prior Service' AND Measure_Period = 'Year 1'"
    elig = "BA_Category = 'Before' AND Measure_Name = 'Eligibility'"
    ip = "BA_Category = 'Before' AND Measure_Name = 'IP Discharges' AND Measure_Period IS NOT NULL"
    dhs = "BA_Category = 'Before' AND Measure_Name = 'DHS'"
    rate = lambda per, base="SurvivalDays": f"Days / nullif({base}, 0) * {per}"

    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        denominator = n_long if spec.wide_denominator == "long_rows" else n_rows
        wide = _wide_cte(spec)
        facets = "year(ServiceEnd) AS yearDC, Flag_Readmit" + (", Flag_Active_DHS_Status" if spec.flags else "")
        facet_names = "yearDC, Flag_Readmit" + (", Flag_Active_DHS_Status" if spec.flags else "")

        def by_facets(key: str, where: str, value: str = "Days") -> str:
            return (f"SELECT Client_Master_BK, {key}, SurvivalDays, {facet_names}, {_strict('Day_Count')} AS {value} FROM "
                    f"(SELECT Client_Master_BK, {key}, SurvivalDays, {facets}, Day_Count FROM tidy WHERE {where}) "
                    f"GROUP BY Client_Master_BK, {key}, SurvivalDays, {facet_names}")

        dist = [("after_dist", f"SELECT *, {rate(30)} AS RateDays30 FROM ({by_facets('LOC', after + ' AND LOC IS NOT NULL')})"),
                ("prior_dist", by_facets("LOC", prior + " AND LOC IS NOT NULL")), ("elig_dist", by_facets("Measure_Period", elig)),
                ("ip_dist", by_facets("Measure_Period", ip, "NAIPDc")), ("dhs_dist", by_facets("Measure_Period", dhs))]
        prior_cols = (f"LOC, count(*) AS N_UsingService, {{perc}}, {_r('avg(Days)', 'AvgDays')}, "
                      f"{_r('avg(' + rate(30, '365') + ')', 'AvgRateDays30')}")
        prior_use = f"SELECT {prior_cols.format(perc=perc(n_members))}, {rank('count(*)')} FROM ({days('LOC, SurvivalDays', prior)}) GROUP BY LOC"
        prior_days = (f"SELECT {prior_cols.format(perc=perc(n_rows))}, {rank('avg(Days)')} FROM ({days('LOC, SurvivalDays', prior)}) GROUP BY LOC")
        add_keys = "Measure_Period, LOC" if spec.additional_by_period else "LOC"
        add_where = "BA_Category = 'Before' AND Measure_Name = 'Additional Service'" + (
            "" if spec.additional_by_period else " AND Measure_Period = 'Year 1'")
        out |= {
            f"service_summary_{name}": _sql(spec, f"SELECT {DIMS}, count(*) AS N_UsingService, {_r('avg(Days)', 'AvgDays')}, "
                                                  f"{_r('quantile_cont(Days, 0.5)', 'MedDays')}, {perc(denominator)} FROM ({days(DIMS, 'TRUE')}) GROUP BY {DIMS}"),
            f"after_summary_{name}": _sql(spec, f"SELECT {DIMS}, count(*) AS N_UsingService, {perc(denominator)}, {_r(f'avg({rate(100)})', 'AvgRateDays100')} "
                                                f"FROM ({days(DIMS + ', SurvivalDays', after)}) GROUP BY {DIMS}"),
            f"after_use_by_loc_{name}": _sql(spec, f"SELECT LOC, count(*) AS N_UsingService, {perc(n_members)}, {_r(f'avg({rate(30)})', 'AvgRateDays30')}, "
                                                   f"{rank('count(*)')} FROM ({days('LOC, SurvivalDays', after)}) GROUP BY LOC"),
            f"after_days_by_loc_{name}": _sql(spec, f"SELECT {DIMS}, count(*) AS N_UsingService, {perc(n_rows)}, {_r(f'avg({rate(30)})', 'AvgRateDays30')}, "
                                                    f"{rank(f'avg({rate(30)})')} FROM ({days(DIMS + ', SurvivalDays', after + ' AND LOC IS NOT NULL')}) GROUP BY {DIMS}"),
            f"after_distribution_{name}": _sql(spec, f"SELECT * REPLACE (round(RateDays30, 6) AS RateDays30) FROM after_dist", dist),
            f"prior_use_by_loc_{name}": _sql(spec, prior_use),
            f"prior_days_by_loc_{name}": _sql(spec, prior_days),
            f"prior_distribution_{name}": _sql(spec, "SELECT * FROM prior_dist", dist),
            f"eligibility_distribution_{name}": _sql(spec, "SELECT * FROM elig_dist", dist),
            f"eligibility_300_{name}": _sql(spec, f"SELECT Measure_Period, count(*) AS N_UsingService, {perc(n_members)}, {_r('avg(' + rate(30, '365') + ')', 'AvgRateDays30')} "
                                                  f"FROM ({days('Measure_Period, SurvivalDays', elig)}) WHERE Days >= 300 GROUP BY 1"),
            f"eligibility_bands_{name}": _sql(spec, f"SELECT Measure_Period, EligCat, n, {_r('n / sum(n) OVER (PARTITION BY Measure_Period)', 'share')} FROM "
                                                    f"(SELECT Measure_Period, {_band('Days', ELIG_DAY_BANDS)} AS EligCat, count(*) AS n FROM ({days('Measure_Period, SurvivalDays', elig)}) GROUP BY 1, 2)"),
            f"eligibility_bands_all_{name}": _sql(spec, f"SELECT Measure_Period, Elig_Cat, n, {_r('n / sum(n) OVER (PARTITION BY Measure_Period)', 'share')} FROM (" + " UNION ALL ".join(
                f"SELECT 'Year {y}' AS Measure_Period, {_band(f'Yr{y}Prior_Elig', ELIG_YEAR_BANDS)} AS Elig_Cat, count(*) AS n FROM wide GROUP BY 2" for y in spec.years) + ")", wide),
            f"ip_by_year_{name}": _sql(spec, f"SELECT Measure_Period, count(*) AS N_UsingService, {perc(n_members)}, {_r('avg(NAIPDc)', 'AvgNDCs')} FROM ip_dist GROUP BY 1", dist),
            f"ip_distribution_{name}": _sql(spec, "SELECT * FROM ip_dist", dist),
            f"box_ip_{name}": _sql(spec, _box("ip_dist", "NAIPDc", ["Measure_Period"]), dist),
            f"additional_services_{name}": _sql(spec, f"SELECT {add_keys}, count(*) AS N_UsingService, {perc(n_members)}, {_r('avg(Days)', 'AvgDays')} "
                                                      f"FROM ({days(add_keys + ', SurvivalDays', add_where)}) GROUP BY {add_keys}"),
        }
        by = {"": [], "_year": ["yearDC"], "_readmit": ["Flag_Readmit"]}
        if spec.flags:
            by["_dhs"] = ["Flag_Active_DHS_Status"]
        for suffix, cols in by.items():
            out[f"box_after{suffix}_{name}"] = _sql(spec, _box_by_loc("after_dist", "RateDays30", cols), dist)
            out[f"box_prior{suffix}_{name}"] = _sql(spec, _box_by_loc("prior_dist", "Days", cols), dist)
            if suffix != "_dhs":
                out[f"box_eligibility{suffix}_{name}"] = _sql(spec, _box("elig_dist", "Days", ["Measure_Period", *cols]), dist)
        if spec.flags:
            out["dhs_by_year_child"] = _sql(spec, f"SELECT Measure_Period, count(*) AS N_UsingService, {perc(n_rows)}, {_r('avg(Days)', 'AvgDays')}, "
                                                  f"{_r('avg(' + rate(30, '365') + ')', 'AvgRateDays30')} FROM ({days('Measure_Period, SurvivalDays', dhs)}) GROUP BY 1")
            out["dhs_use_by_year_child"] = out["dhs_by_year_child"].replace(n_rows, n_members)
            for key, col in {"year": "yearDC", "readmit": "Flag_Readmit"}.items():
                out[f"box_dhs_{key}_child"] = _sql(spec, _box("dhs_dist", "Days", ["Measure_Period", col]), dist)
            out["dhs_distribution_child"] = _sql(spec, "SELECT * FROM dhs_dist", dist)
            out["box_dhs_child"] = _sql(spec, _box("dhs_dist", "Days", ["Measure_Period"]), dist)
    return out


# ---- survival ---------------------------------------------------------------------------------------------

def _km_cte(by: str | None) -> list[tuple[str, str]]:
    """Survival at each event time, by explicit products over the event times up to it."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    known = f"WHERE {by} IS NOT NULL" if by else ""
    return [
        ("risk", f"SELECT {key}t, ev, ce, CAST(sum(ev + ce) OVER ({part} ORDER BY t DESC) AS BIGINT) AS n FROM "
                 f"(SELECT {key}SurvivalDays AS t, CAST(sum(Flag_Readmit) AS BIGINT) AS ev, count(*) - CAST(sum(Flag_Readmit) AS BIGINT) AS ce "
                 f"FROM model {known} GROUP BY {key}SurvivalDays)"),
        ("steps", f"SELECT {key}t, ev, ce, n, product((n - ev) / n) OVER ({part} ORDER BY t) AS s, "
                  f"sum(CASE WHEN n > ev THEN ev / (n * (n - ev)) END) OVER ({part} ORDER BY t) AS hv FROM risk"),
        ("km", f"SELECT {key}t AS time, n AS n_risk, ev AS n_event, ce AS n_censor, round(s, 6) AS survival, "
               f"CASE WHEN s > 0 THEN round(s * sqrt(hv), 6) END AS std_err, "
               f"CASE WHEN s > 0 THEN round(s * exp(-1.959963984540054 * sqrt(hv)), 6) END AS conf_low, "
               f"CASE WHEN s > 0 THEN round(least(1.0, s * exp(1.959963984540054 * sqrt(hv))), 6) END AS conf_high FROM steps WHERE ev > 0"),
    ]


def _logrank_counts(by: str) -> str:
    return f"""
        SELECT g.{by}, g.n, g.observed, {_r('sum(x.d * x.r / x.n)', 'expected')},
        {_r('sum(CASE WHEN x.n > 1 THEN x.d * (x.r / x.n) * (1 - x.r / x.n) * (x.n - x.d) / (x.n - 1) ELSE 0 END)', 'variance')}
        FROM (SELECT {by}, count(*) AS n, CAST(sum(Flag_Readmit) AS BIGINT) AS observed FROM model WHERE {by} IS NOT NULL GROUP BY 1) g
        JOIN (SELECT e.t, e.d, e.n, k.{by}, (SELECT count(*) FROM model m WHERE m.{by} = k.{by} AND m.SurvivalDays >= e.t) AS r
              FROM (SELECT t, sum(ev) AS d, (SELECT count(*) FROM model m WHERE m.{by} IS NOT NULL AND m.SurvivalDays >= risk.t) AS n
                    FROM risk GROUP BY t) e, (SELECT DISTINCT {by} FROM risk) k) x ON x.{by} = g.{by}
        GROUP BY ALL"""


def _chi2_tail(x: str, dof: str) -> str:
    """1 - P(dof / 2, x / 2) by the series of the incomplete gamma function (all terms positive)."""
    a, h = f"({dof} / 2)", f"({x} / 2)"
    return (f"CASE WHEN {dof} <= 0 OR {x} <= 0 THEN 1 ELSE greatest(0, 1 - list_sum([exp(-{h} + ({a} + k) * ln({h}) "
            f"- lgamma({a} + k + 1)) for k in range(0, CAST({x} + 400 AS BIGINT))])) END")


def _logrank(by: str, levels: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """Joint statistic by elimination on the covariance of all declared groups; a group that is absent,
    and the last of those present, has no pivot left and adds nothing."""
    k = range(1, len(levels) + 1)
    r = {i: f"r{i}" for i in k}
    at = "FROM model m WHERE m.SurvivalDays >= e.t AND"
    cells = [(i, j) for i in k for j in k if i <= j]
    cte = [
        ("ev", "SELECT e.t, e.d, e.ds, " + ", ".join(f"(SELECT count(*) {at} m.{by} = {_q(lv)}) AS r{i}" for i, lv in zip(k, levels)) +
         f", (SELECT count(*) {at} m.{by} IS NOT NULL) AS n FROM (SELECT SurvivalDays AS t, count(*) AS d, "
         f"[{', '.join(f'count(*) FILTER (WHERE {by} = {_q(lv)})' for lv in levels)}] AS ds FROM model WHERE Flag_Readmit = 1 AND {by} IS NOT NULL GROUP BY 1) e"),
        ("m0", "SELECT 0.0::DOUBLE AS chisq, 0 AS dof, " + ", ".join(f"sum(ds[{i}] - d * {r[i]} / n) AS u{i}" for i in k) + ", " +
         ", ".join(f"sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END * ({f'{r[i]} / n' if i == j else '0'} - {r[i]} * {r[j]} / (n * n))) AS v{i}{j}"
                   for i, j in cells) + " FROM ev")]
    for p in k:
        ok = f"v{p}{p} > 1e-9"
        v = lambda i, j: f"v{min(i, j)}{max(i, j)}"
        rest = [f"CASE WHEN {ok} THEN u{i} - u{p} * {v(p, i)} / v{p}{p} ELSE u{i} END AS u{i}" for i in k if i > p]
        rest += [f"CASE WHEN {ok} THEN v{i}{j} - {v(p, i)} * {v(p, j)} / v{p}{p} ELSE v{i}{j} END AS v{i}{j}" for i, j in cells if i > p]
        cte.append((f"m{p}", f"SELECT chisq + CASE WHEN {ok} THEN u{p} * u{p} / v{p}{p} ELSE 0 END AS chisq, "
                             f"dof + CASE WHEN {ok} THEN 1 ELSE 0 END AS dof{''.join(', ' + x for x in rest)} FROM m{p - 1}"))
    final = (f"SELECT c.*, {_r('m.chisq', 'chisq')}, m.dof AS df, {_r(_chi2_tail('m.chisq', 'm.dof'), 'p_value')} "
             f"FROM ({_logrank_counts(by)}) c, m{len(levels)} m")
    return final, cte


def _solve(name: str, source: str, p: int) -> tuple[list[tuple[str, str]], str]:
    """Gauss-Jordan steps on a matrix held as rows (i, c, v); a row without a pivot is passed over."""
    steps, prev = [], source
    for k in range(1, p + 1):
        steps.append((f"{name}_{k}", f"""
            SELECT m.i, m.c, CASE WHEN p.v <= 1e-9 THEN m.v WHEN m.i = {k} THEN m.v / p.v ELSE m.v - a.v * r.v / p.v END AS v
            FROM {prev} m JOIN {prev} a ON a.i = m.i AND a.c = {k} JOIN {prev} r ON r.i = {k} AND r.c = m.c
            JOIN {prev} p ON p.i = {k} AND p.c = {k}"""))
        prev = f"{name}_{k}"
    return steps, prev


def _cox_ctes(spec: RunSpec, names: list[str], rounds: int, ties: str = "efron") -> tuple[list[tuple[str, str]], list[str]]:
    """The hazard model with Efron ties as written-out Newton steps: ``est`` holds estimate and
    standard error per term, ``grand`` the likelihoods and test statistics."""
    covs = [next(c for c in spec.covariates if c.name == n) for n in names]
    terms = [(f"{c.name}{lv}", c.name, lv) for c in covs for lv in c.levels[1:]]
    p = len(terms)
    cols = ", ".join(names)
    known = " AND ".join(f"{c.name} IN {_in(c.levels)}" for c in covs)
    ctes = [*_wide_cte(spec), ("model", _model(spec)),
            ("pat", f"SELECT *, row_number() OVER (ORDER BY t, ev, {cols}) AS pid FROM (SELECT SurvivalDays AS t, "
                    f"CAST(Flag_Readmit AS INTEGER) AS ev, {cols}, CAST(count(*) AS DOUBLE) AS k FROM model WHERE {known} GROUP BY ALL)"),
            ("act", " UNION ALL ".join(f"SELECT pid, {i} AS i FROM pat WHERE {c} = {_q(lv)}" for i, (_, c, lv) in enumerate(terms, 1))),
            ("ids", f"SELECT CAST(i AS INTEGER) AS i FROM range(1, {p + 1}) g(i)"),
            ("evd", "SELECT t, CAST(sum(k) AS BIGINT) AS d FROM pat WHERE ev = 1 GROUP BY t"),
            ("evx", "SELECT i, sum(k) AS v FROM pat JOIN act USING (pid) WHERE ev = 1 GROUP BY i"),
            ("ties", f"SELECT t, unnest(range(0, d)) / d * {1 if ties == 'efron' else 0} AS f FROM evd"),
            ("days", "SELECT DISTINCT t FROM pat"),
            ("b0", "SELECT i, CAST(0 AS DOUBLE) AS b FROM ids")]
    for n in range(rounds + 1):
        ctes += [
            (f"w{n}", f"SELECT p.pid, p.t, p.ev, p.k * exp(coalesce(z.s, 0)) AS w FROM pat p LEFT JOIN "
                      f"(SELECT a.pid, sum(b.b) AS s FROM act a JOIN b{n} b USING (i) GROUP BY a.pid) z USING (pid)"),
            (f"z{n}", f"SELECT t, sum(sum(w)) OVER (ORDER BY t DESC) AS s, coalesce(sum(w) FILTER (WHERE ev = 1), 0) AS d FROM w{n} GROUP BY t"),
            (f"x{n}", f"SELECT g.t, g.i, sum(coalesce(q.s, 0)) OVER (PARTITION BY g.i ORDER BY g.t DESC) AS s, coalesce(q.d, 0) AS d "
                      f"FROM (SELECT t, i FROM days, ids) g LEFT JOIN (SELECT t, i, sum(w) AS s, sum(w) FILTER (WHERE ev = 1) AS d "
                      f"FROM w{n} JOIN act USING (pid) GROUP BY t, i) q USING (t, i)"),
            (f"y{n}", f"SELECT g.t, g.i, g.j, sum(coalesce(q.s, 0)) OVER (PARTITION BY g.i, g.j ORDER BY g.t DESC) AS s, coalesce(q.d, 0) AS d "
                      f"FROM (SELECT t, a.i, b.i AS j FROM days, ids a, ids b) g LEFT JOIN (SELECT t, a.i, b.i AS j, sum(w) AS s, "
                      f"sum(w) FILTER (WHERE ev = 1) AS d FROM w{n} JOIN act a USING (pid) JOIN act b USING (pid) GROUP BY ALL) q USING (t, i, j)"),
            (f"h{n}", f"SELECT t, sum(1 / e) AS u0, sum(f / e) AS u1, sum(1 / (e * e)) AS v0, sum(f / (e * e)) AS v1, sum(f * f / (e * e)) AS v2, "
                      f"sum(ln(e)) AS lg FROM (SELECT t, f, z.s - f * z.d AS e FROM ties JOIN z{n} z USING (t)) GROUP BY t"),
            (f"u{n}", f"SELECT x.i, coalesce(any_value(evx.v), 0) - sum(u0 * x.s - u1 * x.d) AS v FROM x{n} x JOIN h{n} USING (t) "
                      f"LEFT JOIN evx ON evx.i = x.i GROUP BY x.i"),
            (f"i{n}", f"SELECT y.i, y.j, sum(u0 * y.s - u1 * y.d - v0 * a.s * b.s + v1 * (a.s * b.d + a.d * b.s) - v2 * a.d * b.d) AS v "
                      f"FROM y{n} y JOIN h{n} USING (t) JOIN x{n} a ON a.t = y.t AND a.i = y.i JOIN x{n} b ON b.t = y.t AND b.i = y.j GROUP BY y.i, y.j"),
            (f"l{n}", f"SELECT coalesce((SELECT sum(evx.v * b.b) FROM evx JOIN b{n} b USING (i)), 0) - (SELECT sum(lg) FROM h{n}) AS v")]
        start = f"SELECT i, j AS c, v FROM i{n} UNION ALL SELECT i, {p + 1}, v FROM u{n}"
        if n == rounds:
            start += f" UNION ALL SELECT a.i, {p + 1} + b.i, CAST(a.i = b.i AS INTEGER) FROM ids a, ids b"
        ctes.append((f"g{n}", start))
        steps, solved = _solve(f"g{n}", f"g{n}", p)
        ctes += steps
        if n < rounds:
            ctes.append((f"b{n + 1}", f"SELECT o.i, o.b + CASE WHEN q.v > 1e-9 THEN g.v ELSE 0 END AS b FROM b{n} o "
                                      f"JOIN i{n} q ON q.i = o.i AND q.j = o.i JOIN {solved} g ON g.i = o.i AND g.c = {p + 1}"))
            if n == 0:
                ctes.append(("scoretest", f"SELECT sum(u.v * g.v) AS v FROM u0 u JOIN {solved} g ON g.i = u.i AND g.c = {p + 1}"))
    names_sql = " UNION ALL ".join(f"SELECT {i} AS i, {_q(t)} AS term" for i, (t, _, _) in enumerate(terms, 1))
    ctes += [
        ("est", f"SELECT n.i, n.term, CASE WHEN q.v > 1e-9 THEN b.b END AS b, CASE WHEN q.v > 1e-9 THEN sqrt(g.v) END AS se FROM ({names_sql}) n "
                f"JOIN b{rounds} b ON b.i = n.i JOIN i0 q ON q.i = n.i AND q.j = n.i JOIN {solved} g ON g.i = n.i AND g.c = {p + 1} + n.i"),
        ("grand", f"SELECT (SELECT CAST(sum(k) AS BIGINT) FROM pat) AS n, (SELECT CAST(sum(d) AS BIGINT) FROM evd) AS n_events, "
                  f"(SELECT count(b) FROM est) AS df, l0.v AS loglik_null, l{rounds}.v AS loglik, (SELECT v FROM scoretest) AS score, "
                  f"(SELECT sum(a.b * b.b * q.v) FROM i{rounds} q JOIN b{rounds} a ON a.i = q.i JOIN b{rounds} b ON b.i = q.j) AS wald FROM l0, l{rounds}")]
    return ctes, [t for t, _, _ in terms]


# The text shown for each term of the full models.
_LABELS = {
    "adult": {
        "Gender_LabelFemale": "Female",
        "RaceCatBlack": "Black (ref: White)",
        "RaceCatHispanic": "Hispanic (ref: White)",
        "RaceCatOther": "Other (ref: White)",
        "AgeCat231 to 40": "31 to 40 (ref: 18-30yo)",
        "AgeCat241 to 50": "41-50 (ref: 18-30yo)",
        "AgeCat251+": "51+ (ref: 18-30yo)",
        "LOScatLT 5 days": "LOS Under 5 (ref: 5+)",
        "FirstEpEverY": "First AIP Ever",
        "After_23HrBedYes": "FUP: 23 Hr Bed",
        "After_BHSICMYes": "FUP: BHSI-CM",
        "After_IOPYes": "FUP: IOP",
        "After_MATYes": "FUP: MAT",
        "After_OPYes": "FUP: OP",
        "After_RehabYes": "FUP: Rehab",
        "After_SubacuteYes": "FUP: Subacute",
        "After_TCMYes": "FUP: TCM",
        "Yr1Prior_23HrBedYes": "Yr1Prior: 23 Hr Bed",
        "Yr1Prior_BHSICMYes": "Yr1Prior: BHSI-CM",
        "Yr1Prior_IOPYes": "Yr1Prior: IOP",
        "Yr1Prior_MATYes": "Yr1Prior: MAT",
        "Yr1Prior_OPYes": "Yr1Prior: OP",
        "Yr1Prior_RehabYes": "Yr1Prior: Rehab",
        "Yr1Prior_SubacuteYes": "Yr1Prior: Subacute",
        "Yr1Prior_TCMYes": "Yr1Prior: TCM",
        "Yr1Prior_AnyAIPYes": "Yr1Prior: AIP",
        "eligcatLess than 50%": "Yr1Prior: Elig < 50% of Yr (ref: 50+%)",
        "eligcatNo Elig": "Yr1Prior: Elig 0 Days (ref: 50+%)",
    },
    "child": {
        "Gender_LabelFemale": "Female",
        "RaceCatHispanic": "Hispanic (ref: Black)",
        "RaceCatOther": "Other (ref: Black)",
        "RaceCatWhite": "White (ref: Black)",
        "Age14upUnder 14": "Under 14 (ref: 14+)",
        "ASDIDNo ASD or ID": "No ASD/ID",
        "MH_SASA": "SA Hx",
        "LOScat11 - 20": "LOS 11-20 (ref: <= 10)",
        "LOScat21-30": "LOS 21-30 (ref: <= 10)",
        "LOScat31+": "LOS 31+ (ref: <= 10)",
        "Flag_Active_DHS_StatusYes": "DHS during AIP",
        "VoluntaryVoluntary": "Voluntary Commitment",
        "FirstEpEverY": "First AIP Ever",
        "After_AcutePartialYes": "FUP: Acute Partial",
        "After_BHRS_CTSSYes": "FUP: BHRS/CTSS",
        "After_FBSYes": "FUP: FB",
        "After_OPYes": "FUP: OP",
        "After_RehabYes": "FUP: Rehab",
        "After_RTFYes": "FUP: RTF",
        "After_STSYes": "FUP: STS",
        "After_TCMYes": "FUP: TCM",
        "Yr1Prior_AcutePartialYes": "YrPrior: Acute Partial",
        "Yr1Prior_BHRS_CTSSYes": "YrPrior: BHRS/CTSS",
        "Yr1Prior_FBSYes": "YrPrior: FB",
        "Yr1Prior_OPYes": "YrPrior: OP",
        "Yr1Prior_RehabYes": "YrPrior: Rehab",
        "Yr1Prior_RTFYes": "YrPrior: RTF",
        "Yr1Prior_STSYes": "YrPrior: STS",
        "Yr1Prior_TCMYes": "YrPrior: TCM",
        "Yr1Prior_DHSYes": "YrPrior: DHS",
        "Yr1Prior_AnyAIPYes": "Yr1Prior: AIP",
        "eligcatLess than 50%": "Elig < 50% of Yr (ref: 50+%)",
    },
}

_Z = 1.959963984540054
_TIDY = (f"i AS term_no, term, {_r('b', 'estimate')}, {_r('se', 'std_error')}, {_r('b / se', 'statistic')}, "
         f"CASE WHEN b IS NOT NULL THEN round({_chi2_tail('(b * b / (se * se))', '1')}, 6) END AS p_value, "
         f"{_r(f'b - {_Z} * se', 'conf_low')}, {_r(f'b + {_Z} * se', 'conf_high')}, TRUE AS converged")


def _cox(spec: RunSpec, names: list[str], rounds: int = 7, ties: str = "efron") -> str:
    ctes, _ = _cox_ctes(spec, names, rounds, ties)
    return _sql(spec, f"SELECT {_TIDY} FROM est", ctes)


def _cox_exact(spec: RunSpec, col: str, reference: str, level: str, rounds: int = 7) -> str:
    """Exact ties with one two-valued covariate: given a day's d events, how many of them have the second value is distributed
    as in a draw of d members from those at risk (``j`` of n1, the others of n0), each of the n1 weighted by exp(b)."""
    ctes = [*_wide_cte(spec), ("model", _model(spec)),
            ("rows1", f"SELECT SurvivalDays AS t, Flag_Readmit AS ev, {col} = {_q(level)} AS x FROM model WHERE {col} IN ({_q(reference)}, {_q(level)})"),
            ("day1", "SELECT e.t, d, d1, count(*) FILTER (WHERE m.x) AS n1, count(*) FILTER (WHERE NOT m.x) AS n0 FROM (SELECT t, count(*) AS d, "
                     "count(*) FILTER (WHERE x) AS d1 FROM rows1 WHERE ev = 1 GROUP BY t) e JOIN rows1 m ON m.t >= e.t GROUP BY e.t, d, d1"),
            ("ways", "SELECT t, j, lgamma(n1 + 1) - lgamma(j + 1) - lgamma(n1 - j + 1) + lgamma(n0 + 1) - lgamma(d - j + 1) - lgamma(n0 - d + j + 1) AS c "
                     "FROM (SELECT *, unnest(range(greatest(0, d - n0), least(d, n1) + 1)) AS j FROM day1)"),
            ("b0", "SELECT CAST(0 AS DOUBLE) AS b")]
    for n in range(rounds + 1):
        ctes += [(f"h{n}", f"SELECT t, j, exp(c + j * b - max(c + j * b) OVER (PARTITION BY t)) AS h FROM ways, b{n}"),
                 (f"m{n}", f"SELECT t, sum(j * h) / sum(h) AS m, sum(j * j * h) / sum(h) - (sum(j * h) / sum(h)) ** 2 AS v FROM h{n} GROUP BY t"),
                 (f"u{n}", f"SELECT sum(d1 - m) AS u, sum(v) AS i FROM m{n} JOIN day1 USING (t)"),
                 (f"b{n + 1}", f"SELECT b + u / i AS b FROM b{n}, u{n}")]
    ctes.append(("est", f"SELECT 1 AS i, {_q(col + level)} AS term, b, 1 / sqrt(u{rounds}.i) AS se FROM b{rounds}, u{rounds}"))
    return _sql(spec, f"SELECT {_TIDY} FROM est", ctes)


def _hazard_ratios(spec: RunSpec, only_significant: bool, rounds: int = 7) -> str:
    ctes, terms = _cox_ctes(spec, [c.name for c in spec.covariates], rounds)
    labels = _LABELS[spec.name]
    shown = " ".join(f"WHEN {_q(t)} THEN {_q(labels[t])}" for t in terms)
    sig = f"CASE WHEN p_value <= {spec.alpha} THEN 'Yes' WHEN p_value IS NOT NULL THEN 'No' END"
    final = f"""
        SELECT t.*, {_r('exp(e.b)', 'HR')}, {_r(f'exp(e.b - {_Z} * e.se)', 'HRconf_low')}, {_r(f'exp(e.b + {_Z} * e.se)', 'HRconf_high')},
        {sig} AS sig, CASE {sig} WHEN 'No' THEN 'No Impact' WHEN 'Yes' THEN CASE WHEN e.b < 0 THEN 'Decreases Risk' ELSE 'Increases Risk' END END AS RiskImpact,
        CASE t.term {shown} ELSE 'ERROR' END AS factors
        FROM (SELECT {_TIDY} FROM est) t JOIN est e ON e.i = t.term_no"""
    return _sql(spec, f"SELECT * FROM ({final}) {'WHERE sig = ' + _q('Yes') if only_significant else ''}", ctes)


def _glance(spec: RunSpec, rounds: int = 7) -> str:
    ctes, _ = _cox_ctes(spec, [c.name for c in spec.covariates], rounds)
    lr = "(2 * (loglik - loglik_null))"
    pairs = f"""(SELECT (sum(a.k * b.k) FILTER (WHERE a.s > b.s) + coalesce(sum(a.k * b.k) FILTER (WHERE a.s = b.s), 0) / 2) / sum(a.k * b.k)
        FROM scored a JOIN scored b ON a.ev = 1 AND (b.t > a.t OR (b.t = a.t AND b.ev = 0)))"""
    scored = ("scored", f"SELECT p.t, p.ev, p.k, round(coalesce(z.s, 0), 12) AS s FROM pat p LEFT JOIN "
                        f"(SELECT a.pid, sum(b.b) AS s FROM act a JOIN b{rounds} b USING (i) GROUP BY a.pid) z USING (pid)")
    return _sql(spec, f"SELECT n, n_events, (SELECT count(*) FROM model) - n AS n_left_out, df, TRUE AS converged, {_r('loglik_null', 'loglik_null')}, {_r('loglik', 'loglik')}, {_r('-2 * loglik + 2 * df', 'aic')}, "
                      f"{_r(lr, 'lr_test')}, {_r(_chi2_tail(lr, 'df'), 'lr_p')}, {_r('score', 'score_test')}, {_r(_chi2_tail('score', 'df'), 'score_p')}, "
                      f"{_r('wald', 'wald_test')}, {_r(_chi2_tail('wald', 'df'), 'wald_p')}, {_r(pairs, 'concordance')} FROM grand", [*ctes, scored])


def _modelling() -> dict[str, str]:
    out = {}
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        wide = _wide_cte(spec)
        model = [*wide, ("model", _model(spec))]
        out[f"wide_members_{name}"] = _sql(spec, "SELECT * FROM wide", wide)
        last_loc, last_short = spec.service_groups[-1]
        renamed = {f"After_{last_short}": f"After_After Service_{spec.after_period}_{last_loc}",
                   **{f"Yr{y}Prior_{last_short}": f"Before_Prior Service_Year {y}_{last_loc}" for y in spec.years}}
        out[f"wide_found_columns_{name}"] = _sql(spec, "SELECT DISTINCT Client_Master_BK, " + ", ".join(
            f'"{old}" AS "{new}"' for old, new in renamed.items()) + " FROM wide", _wide_cte(spec))
        out[f"unlisted_wide_keys_{name}"] = _sql(spec, """
            SELECT concat_ws('_', BA_Category, Measure_Name, coalesce(Measure_Period, 'NA'), coalesce(LOC, 'NA')) AS TimeLOC, count(*) AS n_lines,
                   CAST(sum(Day_Count) AS BIGINT) AS days, TRUE AS known_empty FROM tidy WHERE Measure_Period IS NULL GROUP BY 1""")
        out[f"model_table_{name}"] = _sql(spec, "SELECT * FROM model", model)
        out[f"cox_hazard_ratios_{name}"] = _hazard_ratios(spec, False)
        out[f"cox_significant_{name}"] = _hazard_ratios(spec, True)
        out[f"cox_glance_{name}"] = _glance(spec)
        ctes, terms = _cox_ctes(spec, [c.name for c in spec.covariates], 7)
        out[f"coefficient_limits_{name}"] = _sql(spec, f"SELECT term, estimate, conf_low, conf_high FROM (SELECT {_TIDY} FROM est)", ctes)
        shown = ", ".join(f"({_q(t)})" for t in terms)
        out[f"unlabelled_terms_{name}"] = f"SELECT term, 'ERROR' AS factors FROM (VALUES {shown}) t(term) WHERE term NOT IN {_in(_LABELS[name])}"
        out[f"attribute_fanout_{name}"] = _sql(spec, "SELECT Client_Master_BK, count(*) AS n FROM people GROUP BY 1 HAVING count(*) > 1")
        known = " AND ".join(f"{c.name} IN {_in(c.levels)}" for c in spec.covariates)
        out[f"cox_level_counts_{name}"] = _sql(spec, " UNION ALL ".join(
            f"SELECT {i} AS variable_no, {_q(c.name)} AS variable, {_q(lv)} AS level, count(*) FILTER (WHERE {c.name} = {_q(lv)}) AS n FROM model WHERE {known}"
            for i, c in enumerate(spec.covariates, 1) for lv in c.levels), model)
        for col in spec.km_strata:
            key = {"Flag_Active_DHS_Status": "dhs"}.get(col, col.lower())
            km = [*model, *_km_cte(col)]
            out[f"km_{key}_{name}"] = _sql(spec, "SELECT * FROM km", km)
            out[f"km_median_{key}_{name}"] = _sql(spec, f"SELECT {col}, min(t) FILTER (WHERE s <= 0.5) AS median_time FROM steps WHERE ev > 0 GROUP BY 1", km)
            out[f"km_at_30_{key}_{name}"] = _sql(
                spec, f"SELECT {col}, {_r('coalesce(min(s) FILTER (WHERE t <= 30), 1)', 'survival')} FROM steps WHERE ev > 0 GROUP BY 1", km)
            out[f"logrank_counts_{key}_{name}"] = _sql(spec, _logrank_counts(col), km)
            levels = next((list(c.levels) for c in spec.covariates if c.name == col), list(spec.age_cat.labels))
            final, steps = _logrank(col, levels)
            out[f"logrank_{key}_{name}"] = _sql(spec, final, [*km, *steps])
    out["km_overall_adult"] = _sql(ADULT, "SELECT * FROM km", [*_wide_cte(ADULT), ("model", _model(ADULT)), *_km_cte(None)])
    for key, (spec, names) in COX_CHECKS.items():
        out[key] = _cox(spec, list(names))
        out[key.replace("cox_", "cox_breslow_")] = _cox(spec, list(names), ties="breslow")
    for name, spec in {"adult": ADULT, "child": CHILD}.items():
        out[f"cox_exact_first_episode_{name}"] = _cox_exact(spec, "FirstEpEver", "N", "Y")
    years = [c for c in _wide(ADULT)[1] if c.startswith("Yr")]
    out["wide_again_long_adult"] = _sql(ADULT, " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) AS n, CAST(sum("{c}") AS BIGINT) AS days FROM wide WHERE "{c}" IS NOT NULL HAVING count(*) > 0' for c in years),
        _wide_cte(ADULT))
    return out


# Hazard models with few covariates.
COX_CHECKS = {
    "cox_los_adult": (ADULT, ("LOScat",)),
    "cox_demographics_adult": (ADULT, ("Gender_Label", "RaceCat", "LOScat")),
    "cox_services_adult": (ADULT, ("After_OP", "After_Rehab", "After_TCM", "Yr1Prior_AnyAIP")),
    "cox_demographics_child": (CHILD, ("Gender_Label", "Age14up", "MH_SA", "Voluntary")),
}


def all_sql() -> dict[str, str]:
    return _cohort() | _cleaning() | _description() | _utilization() | _modelling()

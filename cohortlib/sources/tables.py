"""Cohort inputs from the star-schema test tables.

Each function maps a source table to one of the input relations the cohort operators read. Spans are
half-open ``[b, e)``. Only integer arithmetic is used, so other engines derive the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlib.functions.columns import map_values
from cohortlib.spec import RunSpec

# ---- fixed values: service code -> level of care, by age group -----------------------------------
LOC_GROUPS: Mapping[str, Mapping[str, str]] = {
    "adult": {"SMALL": "Outpatient", "SMALL 2": "23-Hour Bed", "MEDIUM": "IOP", "MEDIUM 2": "Acute Partial Adults", "LARGE": "Rehab",
              "LARGE 2": "BHSI Case Mgmt", "ECONOMY": "TCM", "ECONOMY 2": "CIRC", "STANDARD": "ACT", "STANDARD 2": "Methadone",
              "PROMO 2": "Subacute"},
    "child": {"SMALL": "Outpatient", "SMALL 2": "Acute Partial", "MEDIUM": "FB", "MEDIUM 2": "BHRS-CTSS", "LARGE": "Rehab",
              "LARGE 2": "RTF", "ECONOMY": "TCM", "STANDARD": "STS"},
}
SEGMENT_RACE = {"BUILDING": "WHITE", "MACHINERY": "BLACK OR AFRICAN AMERICAN", "AUTOMOBILE": "HISPANIC",
                "FURNITURE": "ASIAN", "HOUSEHOLD": "UNKNOWN"}


@dataclass(frozen=True)
class CohortInputs:
    """The relations a cohort is built from.

    auth: auth, member, sb, se, code · services: member, b, e, sub, code · additional: member, b, e, LOC
    eligibility, dhs, bhrs: member, b, e · members: member and attributes · loc_dim: code, age_group, LOC

    A null end (``se``, ``e``) is a stay or span that is still open. ``sub`` tells apart the lines a member may have for one level of care; it is a code of few values, because
    the extract lists every line.
    """

    auth: DataFrame
    services: DataFrame
    eligibility: DataFrame
    additional: DataFrame
    dhs: DataFrame
    bhrs: DataFrame
    members: DataFrame
    loc_dim: DataFrame
    # Gives the same relations without the rows of other members than those of an index table, and of other times than
    # two dates; takes the index table, the dates, and a function that writes a named table and reads it back.
    narrow: Callable[[DataFrame, date, date, Callable[[str, DataFrame], DataFrame]], CohortInputs] | None = None


def _plus_days(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def _orders(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("o_orderkey").alias("auth"), F.col("o_custkey").alias("member"),
                      F.col("o_orderdate").cast("date").alias("b"), F.col("o_orderpriority").alias("code"))


# ---- fixed value: a service line of this quantity has no end, others last as many days
OPEN_QUANTITY = 50


def _services(lines: DataFrame, owners: DataFrame, part: DataFrame) -> DataFrame:
    """Lines with their order's member and their part's code; lines of other orders than ``owners`` go before anything is joined to them."""
    kept = lines.select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("b"), F.col("l_quantity").cast("int").alias("days"),
                        F.col("l_returnflag").alias("sub"))
    code = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" 2"))
    return (kept.join(owners.select(F.col("auth").alias("l_orderkey"), "member"), "l_orderkey")
            .join(part.select(F.col("p_partkey").alias("l_partkey"), code.alias("code")), "l_partkey")
            .select("member", "b", F.when(F.col("days") != OPEN_QUANTITY, _plus_days(F.col("b"), F.col("days"))).alias("e"), "sub", "code"))


def _day(raw: DataFrame, column: str, day: date) -> Column:
    """A literal of the raw column's own type: a comparison with it reaches the Parquet reader."""
    return F.lit(day.isoformat()).cast(raw.schema[column].dataType)


def load_inputs(spark: SparkSession, sf_dir: str, spec: RunSpec) -> CohortInputs:
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    raw, lines, part = read("orders"), read("lineitem"), read("part")

    def narrow(index: DataFrame, earliest: date, latest: date, keep: Callable[[str, DataFrame], DataFrame]) -> CohortInputs:
        own = keep("own_orders", _orders(raw).join(index.select("member"), "member", "left_semi"))
        begun = F.col("l_shipdate") < _day(lines, "l_shipdate", latest)
        lasting = (F.col("l_quantity") >= OPEN_QUANTITY) | (F.col("l_shipdate") >= _day(lines, "l_shipdate", earliest - timedelta(days=OPEN_QUANTITY)))
        # The order keys of the index members are a table of known size: they are broadcast, or (session.COHORT) a Bloom filter of them
        # reduces the lines before these are shuffled. Their range reaches the scan of the lines, and the planner makes
        # a Bloom filter only of a table with such a predicate.
        low, high = own.agg(F.min("auth"), F.max("auth")).first()
        owners = own.where(F.col("auth").between(F.lit(low), F.lit(high)))
        return relations(own, keep("services", _services(lines.where(begun & lasting), owners, part)))

    def relations(orders: DataFrame, services: DataFrame) -> CohortInputs:
        return _relations(spark, orders, services, read("customer"), spec, narrow)

    return relations(_orders(raw), _services(lines, _orders(raw), part))


def _relations(spark: SparkSession, orders: DataFrame, services: DataFrame, customer: DataFrame, spec: RunSpec, narrow: Callable) -> CohortInputs:
    def spans(code: str, days: Column) -> DataFrame:
        end = F.when(F.col("auth") % 37 != 0, _plus_days(F.col("b"), days))          # some are still open
        return orders.where(F.col("code") == code).select("member", "b", end.alias("e"), "auth")

    auth = orders.select("auth", "member", F.col("b").alias("sb"),
                         F.when(F.col("auth") % 41 != 0, _plus_days(F.col("b"), F.col("auth") % 46)).alias("se"), "code")
    key = F.col("auth")
    if spec.age_group == "adult":
        loc = (F.when(key % 29 == 0, "(450-1) HOST HOMES - DHS CHILD")
               .when(key % 3 == 0, "EAC").when(key % 3 == 1, "JoH").otherwise("RTFA"))
    else:
        loc = F.when(key % 2 == 0, "Host Homes").otherwise("Stepping Stones")
    other = spans("4-NOT SPECIFIED", key % 30)

    cust = F.col("c_custkey")
    age = (18 + (cust * 7) % 60) if spec.age_group == "adult" else (5 + (cust * 7) % 13)
    members = customer.select(
        cust.alias("member"),
        F.when(cust % 2 == 0, "Female").otherwise("Male").alias("Gender_Label"),
        map_values("c_mktsegment", SEGMENT_RACE).alias("RaceEthnic_Label"),
        F.when(cust % 97 != 0, age).cast("int").alias("Age"),
        F.when(cust % 53 == 0, F.lit(None)).when(cust % 11 == 0, "Y").otherwise("N").alias("ASD_Measure_Year"),
        F.when(cust % 13 == 0, "Y").otherwise("N").alias("ID_Measure_Year"),
        F.when(F.col("c_nationkey") % 3 == 0, "SA").otherwise("MH").alias("MH_SA"))

    # Built from literals, so the planner knows how small it is.
    codes = [F.struct(F.lit(code).alias("code"), F.lit(group).alias("age_group"), F.lit(name).alias("LOC"))
             for group, m in LOC_GROUPS.items() for code, name in m.items()]
    loc_dim = spark.range(1).select(F.inline(F.array(*codes)))

    return CohortInputs(
        auth=auth,
        services=services,
        eligibility=spans("3-MEDIUM", 60 + key % 240).drop("auth"),
        additional=other.select("member", "b", "e", loc.alias("LOC")),
        dhs=spans("5-LOW", F.lit(90)).where(F.col("member") % 4 == 0).drop("auth"),
        bhrs=spans("4-NOT SPECIFIED", 300 + key % 600).where(F.col("member") % 5 == 0).drop("auth"),
        members=members,
        loc_dim=loc_dim,
        narrow=narrow)

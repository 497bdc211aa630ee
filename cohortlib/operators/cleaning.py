"""Casting, derived columns, quality filters and exclusion rules of the long extract."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from cohortlib.functions import banded, is_in, level_key, map_values, no_yes, true_only
from cohortlib.spec import AUTH, MEMBER, RACE_MAP, SERVICE_COLUMNS, Rule, RunSpec


def cast_ids(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def parse_mdy(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Month/day/year text to dates; text that is no date gives null. Dates pass through."""
    text = [c for c in cols if isinstance(df.schema[c].dataType, StringType)]
    return df.withColumns({c: F.try_to_date(F.col(c), "M/d/yyyy") for c in text}) if text else df


def null_sentinels(df: DataFrame, sentinels: Mapping[str, str]) -> DataFrame:
    """A text value that stands for missing becomes null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in sentinels.items()})


def relabel_binary(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: no_yes(c) for c in cols})


def as_category(df: DataFrame, col: str, levels: Sequence[str] | DataFrame) -> DataFrame:
    """Add ``<col>_key``, the position of each value in the level order: a declared one, or one found by ``by_appearance``. Values
    outside a found order come after it; a missing value comes last."""
    if not isinstance(levels, DataFrame):
        return df.withColumn(f"{col}_key", level_key(col, levels))
    order = levels.where(F.col("variable") == col).select(F.col("level").alias("_level"), F.col("level_no").alias("_no"))
    n = order.agg(F.count(F.lit(1))).scalar().cast("int")
    return df.join(order, F.col(col).cast("string") == F.col("_level"), "left").select(
        *df.columns, F.when(F.col(col).isNull(), n + 2).otherwise(F.coalesce("_no", n + 1)).alias(f"{col}_key"))


def by_appearance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """variable, level, level_no: the values of some columns in the order in which the files of ``df`` first have them.

    ``df`` is read straight from files. A row stands at its file, in the order of their names, there in its block, and there behind
    the rows that were read before it. The block is read by one task, so the order does not depend on how many
    tasks read the files or in what order they end; only the least place of each level is shuffled. Missing values are no level."""
    pairs = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols))
    placed = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"), F.inline(pairs)).where(F.col("level").isNotNull())
    first = placed.groupBy("variable", "level").agg(F.min(F.struct("file", "block", "row")).alias("first"))
    return first.select("variable", "level", F.row_number().over(W.partitionBy("variable").orderBy("first")).alias("level_no"))


def level_list(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column with their row counts, all columns in one pass."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


def clean_extract(raw: DataFrame, spec: RunSpec) -> DataFrame:
    """Types and missing values of the delivered extract."""
    df = cast_ids(raw, [AUTH, MEMBER, "Readmit_Auth"])
    df = null_sentinels(df, {"Readmit_Auth": "0", "Measure_Period": "NA", "LOC": "NA"})
    if isinstance(df.schema["Readmit_SB"].dataType, StringType):
        df = null_sentinels(df, {"Readmit_SB": "NA"})
    df = parse_mdy(df, ["ServiceBegin", "ServiceEnd", "Readmit_SB"])
    return relabel_binary(df, spec.flags)


def add_los(df: DataFrame) -> DataFrame:
    """Length of stay in nights."""
    return df.withColumn("LOS", F.datediff("ServiceEnd", "ServiceBegin"))


def add_readmit_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("Flag_Readmit", F.when(F.col("Readmit_Auth").isNull(), "No").otherwise("Yes"))


def add_survival_days(df: DataFrame, max_days: int) -> DataFrame:
    """Days until readmission, or the full follow-up for members without one."""
    return df.withColumn("SurvivalDays", F.coalesce("Days_to_Readmit", F.lit(max_days)))


def starting_point(clean: DataFrame, spec: RunSpec) -> DataFrame:
    """Drop the unused columns and add the derived ones."""
    df = add_readmit_flag(add_los(clean.drop(*spec.drop_on_entry)))
    age_name, age_bands = spec.age_model
    derived = {"RaceCat": map_values("RaceEthnic_Label", RACE_MAP), "AgeCat": banded("Age", spec.age_cat)}
    if spec.name == "adult":
        derived[age_name] = banded("Age", age_bands)
    return add_survival_days(df.withColumns(derived), spec.follow_up_days)


def quality_predicate(min_los: int, min_readmit_days: int) -> Column:
    days = F.col("Days_to_Readmit")
    return (F.col("LOS") >= min_los) & (days.isNull() | (days >= min_readmit_days))


def quality_filter(df: DataFrame, min_los: int, min_readmit_days: int) -> DataFrame:
    """Drop same-day stays and readmissions so quick that they may be transfers."""
    return df.where(quality_predicate(min_los, min_readmit_days))


def rule_matches(rule: Rule) -> Column:
    """Never null: a missing value does not match a value condition."""
    out = F.lit(True)
    for col, values in rule.values:
        out = out & is_in(col, values)
    for col in rule.null:
        out = out & F.col(col).isNull()
    return out


def exclude(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    for rule in rules:
        df = df.where(~rule_matches(rule))
    return df


def tidy_long(start: DataFrame, spec: RunSpec) -> DataFrame:
    return exclude(quality_filter(start, spec.min_los, spec.min_readmit_days), spec.rules)


def member_table(df: DataFrame, drop: Sequence[str] = (*SERVICE_COLUMNS, "RaceEthnic_Label")) -> DataFrame:
    """Distinct member and index-episode attributes without the service columns."""
    return df.drop(*drop).distinct()


def cleaning_steps(spec: RunSpec) -> list[tuple[str, Column]]:
    keep = [("quality", true_only(quality_predicate(spec.min_los, spec.min_readmit_days)))]
    return keep + [(r.name, ~rule_matches(r)) for r in spec.rules]


def stage_audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows entering, removed by and leaving each filter, from a single scan."""
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("s0")]
    for i, (_, keep) in enumerate(steps, 1):
        kept = kept & keep
        counts.append(F.count_if(kept).alias(f"s{i}"))
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"s{i - 1}").alias("rows_in"),
                     (F.col(f"s{i - 1}") - F.col(f"s{i}")).alias("rows_removed"), F.col(f"s{i}").alias("rows_out"))
            for i, (name, _) in enumerate(steps, 1)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count the rows of an intermediate table while the job that uses it runs."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def quality_checks(members: DataFrame, spec: RunSpec) -> DataFrame:
    """Counts an analyst expects to be zero: readmissions too quick, stays of zero nights."""
    return members.agg(
        F.count_if(F.col("Days_to_Readmit") < spec.quick_readmit_below).alias("quick_readmits"),
        F.count_if(F.col("LOS") == 0).alias("short_stays"))

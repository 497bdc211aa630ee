"""Reading the delivered extract, and reading and writing intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("AuthorizationNumber", "Client_Master_BK", "ServiceBegin", "ServiceEnd", "Gender_Label", "RaceEthnic_Label")
_MID = ("ASD_Measure_Year", "ID_Measure_Year", "LOC_Label", "FirstEpEver", "MH_SA", "BA_Category", "Measure_Name",
        "Measure_Period", "LOC")
_TAIL = ("Ep180", "Post_Discharge_RTF_Start", "Post_Discharge_Days_to_RTF", "Clinical_Category",
         "HasServ_Before_Readmit")

# The delivered file: dates are month/day/year text, "NA" and "" both mean missing.
EXTRACT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("Age", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in _MID]
    + [T.StructField("Day_Count", T.LongType()),
       T.StructField("Readmit_Auth", T.StringType()),
       T.StructField("Readmit_SB", T.StringType()),
       T.StructField("Days_to_Readmit", T.IntegerType()),
       T.StructField("Flag_BHRS_18plus_Mths_Before_Admission", T.IntegerType()),
       T.StructField("Flag_Active_DHS_Status", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in _TAIL]
)


def read_extract(spark: SparkSession, path: str, schema: T.StructType | None = EXTRACT_SCHEMA) -> DataFrame:
    """CSV with a header. Columns are found by their names, in whatever order the file has them, and cast to the types of
    the schema; one that the file lacks is an error. Cells that do not fit their type are null: ``malformed_cells``
    counts them. Without a schema every column gets the narrowest type that all its cells fit (``guess_types``)."""
    raw = _as_text(spark, path)
    return _by_name(raw, schema) if schema is not None else _as_guessed(raw)


# ---- fixed values: the types that are tried, from narrow to wide, and the form of dates; anything else is text
_LOGICAL = "^(TRUE|FALSE|true|false|T|F)$"
_DATE = "M/d/yyyy"
# What every date and every number has at least. Casts that fail throw and catch errors inside, which takes many times as long as these.
_DATE_MARK = "/"
_NUMBER_MARK = r"(?i)^[\x00-\x20]*[+-]?(inf|infinity|nan|[0-9.][0-9a-fxp.+-]*)[\x00-\x20]*$"
_TRIED = ("boolean", "int", "bigint", "double", "date")


def _fits(cell: Column, kind: str) -> Column:
    if kind == "boolean":
        return cell.rlike(_LOGICAL)
    if kind == "date":
        return F.when(cell.contains(_DATE_MARK), F.try_to_date(cell, _DATE).isNotNull()).otherwise(False)
    cast = cell.try_cast(kind).isNotNull()
    return F.when(cell.rlike(_NUMBER_MARK), cast).otherwise(False) if kind == "double" else cast


def guess_types(raw: DataFrame) -> DataFrame:
    """column, type, n, n_missing, unfit: for each text column the narrowest of boolean, int, bigint, double, date and string that all
    its cells fit, the cells with and without a value, and how many do not fit each type tried, which is what made
    the type wider. A column without any value is text. All cells count, in one pass; a text is tried once for all cells of a column that
    hold it, as they are counted before they are shuffled. Only the names and types of a file's columns are ever gathered."""
    cells = raw.select(F.posexplode(F.array(*(F.col(f"`{c}`") for c in raw.columns))).alias("i", "cell"))
    texts = cells.groupBy("i", "cell").agg(F.count(F.lit(1)).alias("k"))
    cells_where = lambda held: F.sum(F.when(held, F.col("k")).otherwise(0))
    known = F.col("cell").isNotNull()
    unfit = [cells_where(known & ~_fits(F.col("cell"), kind)).alias(kind) for kind in _TRIED]
    counts = texts.groupBy("i").agg(cells_where(known).alias("n"), cells_where(~known).alias("n_missing"), *unfit)
    kind = F.when(F.col("n") == 0, "string")
    for k in _TRIED:
        kind = kind.when(F.col(k) == 0, k)
    names = F.element_at(F.array(*map(F.lit, raw.columns)), F.col("i") + 1)
    return counts.select(names.alias("column"), kind.otherwise("string").alias("type"), "n", "n_missing", F.struct(*_TRIED).alias("unfit"))


def _as_guessed(raw: DataFrame) -> DataFrame:
    kinds = {r["column"]: r["type"] for r in guess_types(raw).select("column", "type").collect()}
    cast = {"date": lambda c: F.try_to_date(c, _DATE), "string": lambda c: c, "boolean": lambda c: F.upper(c).startswith("T")}
    of = lambda c: cast.get(kinds.get(c, "string"), lambda x: x.cast(kinds[c]))(F.col(f"`{c}`"))
    return raw.select(*(of(c).alias(c) for c in raw.columns))


def _as_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, nullValue="NA", inferSchema=False)


def _by_name(raw: DataFrame, schema: T.StructType) -> DataFrame:
    absent = [f.name for f in schema if f.name not in raw.columns]
    if absent:
        raise ValueError(f"the extract lacks the columns {absent}")
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def malformed_cells(spark: SparkSession, path: str, schema: T.StructType = EXTRACT_SCHEMA) -> DataFrame:
    """column, n: cells of the file that hold a text but do not fit the column's type."""
    raw = _as_text(spark, path)
    typed = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    _by_name(raw, schema)
    counts = raw.agg(*(F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in typed))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("n")) for f in typed))))


def write_stage(df: DataFrame, directory: str, name: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> str:
    """Write one intermediate table; ``csv`` writes a header and missing values as empty text."""
    path = f"{directory.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, nullValue="", emptyValue="")
    else:
        writer.format(fmt).save(path)
    return path


def read_stage(spark: SparkSession, directory: str, name: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Read an intermediate table back, in any later session."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    path = f"{directory.rstrip('/')}/{name}"
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def write_bucketed(df: DataFrame, directory: str, name: str, key: str, buckets: int, partition_by: Sequence[str] = ()) -> str:
    """Write one intermediate table in buckets of ``key``, as an external table of the session's catalog, and give its name.

    Joins and aggregations by ``key`` of tables with equal bucket numbers need no exchange. The rows should come partitioned by
    ``key`` already: then each bucket is one file. Meant for tables with a bounded number of rows for each key, as a
    bucket is never split; ``read_stage`` reads the same files without buckets."""
    table = f"stage_{uuid.uuid4().hex[:12]}_{name}"
    df.write.partitionBy(*partition_by).bucketBy(buckets, key).option("path", f"{directory.rstrip('/')}/{name}").saveAsTable(table)
    return table

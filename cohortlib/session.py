"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# One member (or level of care) may own a large share of all rows. Splitting such a partition inside
# a join is worth an extra exchange after it, so the split is allowed even where the following
# aggregation would otherwise reuse the join's partitioning.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Options of a cohort run.
COHORT = {
    # Keys of a cohort reduce the fact table before it is shuffled, also where they are too many to be broadcast: up to 2^30 bits
    # (128 MB) of a Bloom filter, built from a side of at most 16 GB for a fact table of 1 GB and more.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "100000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "1073741824",
}


def tune(spark: SparkSession, more: Mapping[str, str] | None = None) -> SparkSession:
    """Set the runtime options the operators count on (all are per-session SQL options)."""
    for key, value in {**TUNING, **(more or {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="cohortlib-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def new_stage_dir(spark: SparkSession) -> str:
    """A fresh folder for one run's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/cohortlib/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

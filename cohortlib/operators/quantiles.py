"""Exact quantiles of very large groups, by narrowing down the range that holds each rank.

A built-in percentile gathers all distinct values of a group in one buffer. Here a group's values are only counted in BINS
bins between the least and the greatest; of the bin that holds the wanted rank the least and the greatest value bound the next, finer
bins. After LEVELS rounds what is left for a rank is a BINS ** LEVELS-th of the group where values are spread out, and a
single value where they are not; it is sorted and counted through. Bins are counted before they are shuffled, and a task sees at
most BINS rows for a rank and round, whatever the size of the group. No round runs a job of its own: all are one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS = 1024
LEVELS = 2


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(and_, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in keys))


def quantiles(freq: DataFrame, keys: Sequence[str], probabilities: Sequence[float], bins: int = BINS, levels: int = LEVELS) -> DataFrame:
    """keys, n, q: the quantiles of each group of ``freq`` (keys, v, k: distinct values with their counts) as an array, each
    interpolated between the two values around it (type 7). Values are not null; a null key is a group of its own."""
    sizes = freq.groupBy(*keys).agg(F.sum("k").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(2 * i).alias("t"), F.floor(at).alias("rank")), F.struct(F.lit(2 * i + 1).alias("t"), F.ceil(at).alias("rank"))]
    named = [F.col(c).alias(f"_{c}") for c in keys]
    wanted = sizes.select(*named, "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.inline(F.array(*ranks)))
    group = [f"_{c}" for c in keys] + ["t"]
    for _ in range(levels):
        met = _within(freq, wanted, keys)
        share = (F.col("v").cast("double") - F.col("lo")) / (F.col("hi").cast("double") - F.col("lo"))
        number = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0)
        counted = met.groupBy(*group, "rank", "below", number.alias("bin")).agg(F.sum("k").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        wanted = _holding(counted, group, "bin").select(*group, "rank", "lo", "hi", "below")
    met = _within(freq, wanted, keys).select(*group, "rank", "below", "v", F.col("k").alias("c"))
    values = _holding(met, group, "v").groupBy(*group[:-1]).agg(
        *(F.max(F.when(F.col("t") == t, F.col("v").cast("double"))).alias(f"x{t}") for t in range(2 * len(probabilities))))
    out = values.join(sizes.select(*keys, "n"), _same(keys, "_"))
    q = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}")
        q.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return out.select(*keys, "n", F.array(*q).alias("q"))


def _within(freq: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values in the range that holds a rank, for each rank. There are few ranks, one for each group and quantile."""
    return freq.join(wanted, _same(keys, "_") & F.col("v").between(F.col("lo"), F.col("hi")))


def _holding(counted: DataFrame, group: Sequence[str], by: str) -> DataFrame:
    """The row of each group in which its rank falls, counting on from ``below`` in the order of ``by``."""
    upto = F.col("below") + F.sum("c").over(W.partitionBy(*group).orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    return counted.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).withColumn(
        "below", F.col("upto") - F.col("c"))

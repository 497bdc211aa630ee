"""Mixing sources to target weights along a curriculum that changes over training.

Every source has a target number of words (its share by weight, at most a number of passes over it; what is above is
shared out again by weight until no source is above). Its weight may change while training goes on: a schedule goes
in straight line from a start to an end value, and its integral says which part of the target is due by each time. A
document's place in its source's word stream is turned into a time by inverting that integral, and all
documents are sorted by time into training positions.

The stream of a source repeats its documents in a fixed hashed order, so reruns agree. It ends at the source's target:
the document at the end is cut there, or, with ``whole``, taken if its middle word lies below the target (then a source
misses its target by at most half a document). Sizes are words; texts without words take no place. A null source is a source of its own, after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import WORD, fresh, partitions, running_totals, stage

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
SEED = 17


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size, weight, target and before (the sizes of all sources ahead) from rows with source and size.

    Weights repeat over the sources in code-point order, null last. The level L with sum(min(cap, L * weight)) = total
    is found by sharing out again what capped sources leave. Each turn is one small aggregation that the driver sees
    as three numbers; a turn caps at least one more source, or ends."""
    sizes = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "source_sizes")
    ranked = running_totals(sizes, [F.col("source").asc_nulls_last()], {"rank": "one", "before": "source_size"})
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", "before", pick.alias("weight")), "ranked")
    cap = F.col("source_size") * float(most_passes)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = cap <= level * F.col("weight")
        n, full, rest = ranked.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)),
                                   F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - full) / rest
    return ranked.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")))


def schedule(weight: Column) -> tuple[Column, Column]:
    """Relative weight at the start and at the end of training: sources of the highest weight come late, of the lowest early."""
    step = (weight - WEIGHTS[0]) / float(WEIGHTS[-1] - WEIGHTS[0])
    return 1.5 - step, 0.5 + step


def due_time(share: Column, start: Column, end: Column) -> Column:
    """The time in [0, 1] by which a share of a target is due, if the weight goes straight from start to end.

    The share due by t is (start t + (end - start) t^2 / 2) / ((start + end) / 2); this is its inverse, in the form
    that needs no case for start = end."""
    return share * (start + end) / (start + F.sqrt(start * start + (end * end - start * start) * share))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the number of words of each text as size."""
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))


def placed(rows: DataFrame, whole: bool, most_passes: int = MOST_PASSES) -> DataFrame:
    """How often each row is taken, and where its source's stream has it.

    ``rows`` has row (a unique number), source, size and tie (any value that tells texts of one size apart). Returns
    row, size, source_size, target, passes, weight, start (words of its source ahead of it)."""
    rows = stage(rows.select("row", "source", "size", "tie", F.xxhash64(F.lit(SEED), "tie").alias("order")), "sized")
    found = stage(targets(rows, most_passes=most_passes), "targets")
    ahead = running_totals(rows, [F.col("source").asc_nulls_last(), F.col("order"), F.col("tie"), F.col("size")], {"ahead": "size"})
    ahead = stage(ahead.select("row", F.col("source").alias("own"), "size", "ahead"), "ahead")
    rows = ahead.join(found, F.col("own").eqNullSafe(F.col("source")), "left").withColumn("start", F.col("ahead") - F.col("before"))
    left = F.col("target") - F.col("start") - F.col("size") / 2.0 if whole else F.round("target") - F.col("start")
    passes = F.when((F.col("size") > 0) & (left > 0), F.ceil(left / F.col("source_size"))).otherwise(0)
    return rows.select("row", "size", "source_size", "target", "weight", "start",
                       F.least(passes, F.lit(most_passes)).cast("int").alias("passes"))


def positions(placed_rows: DataFrame, whole: bool) -> DataFrame:
    """row, words, pass, time, position for every time a row is taken: position counts the words of the mix ahead of it."""
    begin, end = schedule(F.col("weight"))
    ahead = F.col("pass") * F.col("source_size") + F.col("start")
    words = F.col("size") if whole else F.least("size", F.round("target").cast("long") - ahead)
    share = F.least((ahead + words / 2.0) / F.col("target"), F.lit(1.0))
    taken = (placed_rows.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
             .select("row", words.alias("words"), "pass", due_time(share, begin, end).alias("time"), "start"))
    # Rows of equal time stand in the order of their streams, which does not depend on how the input was split.
    return running_totals(taken, [F.col("time"), F.col("start"), F.col("pass"), F.col("words")], {"position": "words"}).drop("start")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), passes and first_position of every row.

    first_position counts the words of the mix before the row is first used; it is null for rows that are not taken."""
    rows = sized(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "size", F.xxhash64("doc_id", "text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "documents")
    plan = stage(placed(rows, whole=False), "plan")
    used = positions(plan, whole=False).groupBy("row").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"))
    return (rows.select("row", "doc_id").join(plan, "row").join(used, "row", "left")
            .select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
                    F.coalesce("taken", F.lit(0)).alias("taken"), "passes", "first_position"))


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents of the mix in training order: each row as often as it is taken, whole, range-sorted by position."""
    row, at = fresh(docs, "row", "position")
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "held")
    tie = F.xxhash64("doc_id", "text")
    rows = sized(held.select("doc_id", "source", "text", F.col(row).alias("row"))).select("row", "source", "size", tie.alias("tie"))
    order = positions(stage(placed(rows, whole=True), "plan"), whole=True).select(F.col("row").alias(row), F.col("position").alias(at))
    joined = held.join(stage(order, "order"), row)
    return (joined.repartitionByRange(partitions(docs.sparkSession), at).sortWithinPartitions(at).select(*docs.columns))

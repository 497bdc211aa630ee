"""Quality rules judged by host: a document's own failures, and the failure rate of the domain it comes from.

Every rule is one expression of built-in functions over the row, so nothing is exploded or shuffled to compute it.
Failures are added up by domain; each domain's rate is shrunk towards the rate of all domains by a beta prior that
is fitted to the domains' own spread (method of moments), so a domain with few documents is not judged by chance.
A domain whose shrunk rate is above a limit is rejected, and the verdict is joined back to its documents.

Null and empty texts have no words and fail. A null domain is a domain of its own. Repeated rows count each time. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlib.llm.helpers import WORD, fresh, stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
HOST_LIMIT = 0.5                                           # reject a domain above this shrunk failure rate


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for the row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Number of words in windows of three that occur twice or more in the array ``words`` of size ``n``.

    Windows are told apart by a 64-bit hash. Without a repeated hash the answer is 0; else the hashes are sorted with
    their positions, equal neighbours give the starts of repeated windows, and each start adds the words up to the
    next start (three at most)."""
    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def starts_of(sorted_pairs: Column) -> Column:
        same = F.filter(sorted_pairs, lambda x, i: (x["h"] == F.get(sorted_pairs, i - 1)["h"]) | (x["h"] == F.get(sorted_pairs, i + 1)["h"]))
        return bind(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(bind(F.array_sort(pairs), starts_of))

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(n < WINDOW, 0).otherwise(bind(windows, of))


def counts(text: Column) -> Column:
    """A struct of a text's word and line counts."""
    def of(words: Column) -> Column:
        return bind(F.size(words), lambda n: F.struct(
            n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.coalesce(repeated_words(words, n), F.lit(0)).cast("long").alias("n_repeat_words")))

    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    duplicate = bind(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))
    return F.struct(bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of).alias("words"),
                    F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    duplicate.cast("long").alias("n_dup_lines"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ADDED = (*MEASURES, "host_rate", "host_rejected", "kept")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """MEASURES beside the other columns of ``docs``, the text left out; a column of the same name gives way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in ADDED]
    c = F.col("_counts")
    n, repeated = c["words"]["n_words"], c["words"]["n_repeat_words"]
    return docs.select(*rest, counts(F.col(text)).alias("_counts")).select(
        *rest, n.alias("n_words"), c["words"]["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed(c).alias("base_failed"))


def failed(c: Column) -> Column:
    n = c["words"]["n_words"]
    return (n < MIN_WORDS) | (100 * c["words"]["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def hosts(measures: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per domain: documents, failures, shrunk failure rate, rejected.

    ``measures`` has the domain and base_failed. The prior beta(a, b) has the mean m of all documents, and a + b from
    the spread of the domains' rates around m beyond what chance gives: with n_i documents and f_i failures,
    rho = (sum n_i (f_i/n_i - m)^2 - (k - 1) m (1 - m)) / ((N - sum n_i^2 / N - (k - 1)) m (1 - m)), kept in
    [1e-6, 1], and a + b = 1/rho - 1. Without any failure, without any success or with one domain only, the domain's
    rates are left as they are."""
    per = (measures.groupBy(F.col(host).alias("host"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    per = stage(per, "hosts")
    n, rate = F.col("n").cast("double"), F.col("failed") / F.col("n")
    mean = per.agg((F.sum("failed") / F.sum("n")).alias("m")).scalar()
    k, total = F.count(F.lit(1)), F.sum(n)
    m, chance = F.first("m"), F.first(F.col("m") * (1 - F.col("m")))
    spread = F.sum(n * (rate - F.col("m")) ** 2)
    below = (total - F.sum(n * n) / total - (k - 1)) * chance
    rho = F.greatest(F.least((spread - (k - 1) * chance) / F.when(below > 0, below), F.lit(1.0)), F.lit(1e-6))
    prior = per.withColumn("m", mean).agg((1 / rho - 1).alias("weight"), m.alias("m"))
    weight = prior.select(F.coalesce("weight", F.lit(0.0))).scalar()
    shrunk = (F.col("failed") + F.coalesce(mean, F.lit(0.0)) * weight) / (F.col("n") + weight)
    return per.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > limit)


def judged(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every document, its domain's shrunk rate and verdict, and ``kept``: its own rules and its domain
    pass. The text is left out."""
    return _with_verdict(stage(measured(docs), "measured"), host, "base_failed", limit, "host_rate", "host_rejected", "kept")


def passing(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that stay, with all their columns as they were."""
    flag, rate, rejected, kept = fresh(docs, "failed", "rate", "rejected", "kept")
    rows = stage(docs.withColumn(flag, failed(counts(F.col("text")))), "measured")
    return _with_verdict(rows, host, flag, limit, rate, rejected, kept).where(F.col(kept)).select(*docs.columns)


def _with_verdict(rows: DataFrame, host: str, flag: str, limit: float, rate: str, rejected: str, kept: str) -> DataFrame:
    """The verdict table is written first, so the planner knows its size: it is broadcast only when small; else the
    rows of large domains are split by the adaptive skew join."""
    (name,) = fresh(rows, "host")
    found = hosts(rows.select(F.col(host).alias("source"), F.col(flag).alias("base_failed")), limit=limit)
    found = stage(found.select(F.col("host").alias(name), F.col("rate").alias(rate), F.col("rejected").alias(rejected)), "verdicts")
    return (rows.join(found, F.col(host).eqNullSafe(F.col(name)), "left").drop(name)
            .withColumn(kept, ~F.col(flag) & ~F.col(rejected)))

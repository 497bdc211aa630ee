"""A study: one cohort run over one set of input tables, with its intermediate tables.

The episodes, the days of use, the cleaned long table, the member table and the wide table feed almost every
report. Each is written once as Parquet below ``spark.checkpoint.dir`` and read back, so reports share
the work, prune columns and directories at the scan, and do not depend on executor memory. These tables have a bounded
number of rows per member and are bucketed by member, so they are joined and grouped without exchange. The index and the rows of the
index members are not bucketed: a member may own very many of these rows, and only partitions that come from an exchange can be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlib.operators import cleaning, cohort, cox, reshape, utilization
from cohortlib.session import COHORT, new_stage_dir, tune
from cohortlib.sources.extract import read_stage, write_bucketed, write_stage
from cohortlib.sources.tables import CohortInputs, load_inputs
from cohortlib.spec import MEMBER, RunSpec

# ---- fixed values: while tables are staged, index members per partition, and bytes of an exchange or of files that are read as one
MEMBERS_PER_PARTITION = 2500
STAGE_TASK_BYTES = "16m"


class Study:
    def __init__(self, spark: SparkSession, inputs: CohortInputs | None, spec: RunSpec, twin: Study | None = None):
        """``twin`` is a study of the same tables; relations it has computed are not computed again."""
        self.twin = twin
        self.spark, self.given, self.spec = tune(spark, COHORT), inputs, spec
        self.stage_dir = new_stage_dir(spark)
        self.fits: dict[tuple[str, ...], cox.CoxFit] = {}
        self.tables: list[str] = []
        self.kept: dict[str, DataFrame] = {}

    @classmethod
    def from_extract(cls, spark: SparkSession, extract: DataFrame, spec: RunSpec) -> Study:
        """A study that starts from a delivered long extract (see ``read_extract``) instead of raw relations."""
        st = cls(spark, None, spec)
        st.extract = extract
        return st

    @cached_property
    def partitions(self) -> int:
        """As many as the session has, and more where the index members are many: so a task's share does not grow with them."""
        members = self.index.count() if self.given else self.extract.agg(F.approx_count_distinct(MEMBER)).first()[0]
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(members / MEMBERS_PER_PARTITION))

    @contextmanager
    def _small_tasks(self, partitions: int | None = None) -> Iterator[None]:
        """The session's options for scans and exchanges while a table is staged; the former ones return afterwards. A task that reads
        files holds its rows until they are written for the exchange, so its share of the files is as small as that of an exchange."""
        options = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": STAGE_TASK_BYTES, "spark.sql.files.maxPartitionBytes": STAGE_TASK_BYTES}
        if partitions:
            options["spark.sql.shuffle.partitions"] = str(partitions)
        former = {key: self.spark.conf.get(key, None) for key in options}
        tune(self.spark, options)
        try:
            yield
        finally:
            for key, value in former.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def _staged(self, name: str, df: DataFrame) -> DataFrame:
        with self._small_tasks(self.partitions):
            write_stage(df, self.stage_dir, name)
        return read_stage(self.spark, self.stage_dir, name)

    def _bucketed(self, name: str, df: DataFrame, key: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Rows come partitioned by ``key`` from an exchange, so each bucket is written by one task."""
        with self._small_tasks(self.partitions):
            self.tables.append(write_bucketed(df, self.stage_dir, name, key, self.partitions, partition_by))
        return self.spark.table(self.tables[-1])

    def _shares(self, other: Study | None) -> bool:
        """Whether the other study has the same index members and looks at the same time."""
        fields = ("period_begin", "period_end", "index_codes", "follow_up_days", "year_days", "prior_years")
        return other is not None and all(getattr(self.spec, f) == getattr(other.spec, f) for f in fields)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.kept:
            shared = self.twin.kept.get(name) if self._shares(self.twin) else None
            self.kept[name] = self._staged(name, df) if shared is None else shared
        return self.kept[name]

    @cached_property
    def bounds(self) -> tuple[date, date]:
        """The first day of any member's prior years, and the last day of any follow-up: one row from the staged index."""
        first = self.index.agg(F.min("sb")).first()[0] or self.spec.period_begin
        return (first - timedelta(days=self.spec.year_days * self.spec.prior_years), self.spec.period_end + timedelta(days=self.spec.follow_up_days))

    @cached_property
    def inputs(self) -> CohortInputs:
        """The given relations; where they can be, reduced to the index members and the time studied."""
        return self.given.narrow(self.index, *self.bounds, self._keep) if self.given.narrow else self.given

    def release(self) -> None:
        """Delete the study's intermediate tables."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.stage_dir)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    @cached_property
    def index(self) -> DataFrame:
        """One row per member: the index episode. Staged, so that every join of it starts from an exchange."""
        with self._small_tasks():
            write_stage(cohort.index_episodes(self.given.auth, self.spec), self.stage_dir, "index")
        return read_stage(self.spark, self.stage_dir, "index")

    @cached_property
    def episodes(self) -> DataFrame:
        """One row per member: index episode, readmission, event counts, window after discharge."""
        return self._bucketed("episodes", cohort.episodes(self.index, self.inputs.auth, self.spec), "member")

    @cached_property
    def days(self) -> DataFrame:
        """Days of use per member, kind of span and level of care: one pass over all spans. The episodes are read without their
        buckets here, so that a member's spans can be split."""
        _ = self.episodes
        plain = read_stage(self.spark, self.stage_dir, "episodes")
        spans = cohort.tagged_spans(self.inputs, *self.bounds)
        return self._bucketed("days", cohort.span_days(plain, spans, self.inputs.loc_dim, self.spec), "member")

    @cached_property
    def extract(self) -> DataFrame:
        return cohort.to_extract(self.episodes, self.days, self.inputs.members, self.spec)

    @property
    def clean(self) -> DataFrame:
        return cleaning.clean_extract(self.extract, self.spec)

    @cached_property
    def start(self) -> DataFrame:
        """All lines with derived columns, before any row is dropped. The one exchange of lines: everything after it is by
        member, whose id is text from here on."""
        lines = cleaning.starting_point(self.clean, self.spec).repartition(MEMBER)
        return self._bucketed("start", lines, MEMBER, ("BA_Category", "Measure_Name"))

    @property
    def long(self) -> DataFrame:
        """Cleaned long table. The staged lines lie in one directory per measure, so a report that
        needs one measure reads only its files; the row filters are cheap enough to repeat."""
        return cleaning.tidy_long(self.start, self.spec)

    @cached_property
    def members(self) -> DataFrame:
        return self._bucketed("members", cleaning.member_table(self.long), MEMBER)

    @cached_property
    def sketches(self) -> DataFrame:
        """Sketches of the members of every measure, period and level of care, kept beside the staged lines."""
        return self._staged("sketches", utilization.member_sketches(self.long))

    @cached_property
    def wide(self) -> DataFrame:
        """One row per member with a column for each measure, period and level of care; levels of care that are not declared get one too."""
        found = reshape.found_wide_keys(self.long, self.spec)
        return self._bucketed("wide", reshape.wide_members(self.long, self.members, self.spec, found), MEMBER)

    @property
    def model(self) -> DataFrame:
        return reshape.model_table(self.wide, self.spec)

    @property
    def fit(self) -> cox.CoxFit:
        """The hazard model with all covariates of the run."""
        return self.fit_of([c.name for c in self.spec.covariates])

    def fit_of(self, names: Sequence[str], ties: str = "efron") -> cox.CoxFit:
        """The hazard model with some of the covariates, fitted once. Its pattern table is staged, so ``release`` removes it."""
        key = (*names, ties)
        if key not in self.fits:
            chosen = [next(c for c in self.spec.covariates if c.name == n) for n in names]
            self.fits[key] = cox.cox_ph(self.model, "SurvivalDays", "Flag_Readmit", chosen, ties=ties,
                                        keep=lambda df: self._staged(f"patterns_{len(self.fits)}", df))
        return self.fits[key]

    # -- denominators: scalar subqueries, evaluated inside the query that uses them ------------------

    @property
    def n_members(self) -> Column:
        return self.members.agg(F.count_distinct(MEMBER)).scalar()

    @property
    def n_member_rows(self) -> Column:
        return self.members.agg(F.count(F.lit(1))).scalar()

    @property
    def n_long_rows(self) -> Column:
        return self.long.agg(F.count(F.lit(1))).scalar()

    @property
    def wide_denominator(self) -> Column:
        return self.n_long_rows if self.spec.wide_denominator == "long_rows" else self.n_member_rows


_studies: dict[tuple[str, str, RunSpec], Study] = {}


def study(spark: SparkSession, sf_dir: str, spec: RunSpec) -> Study:
    """The session's study of these tables; inputs are taken as unchanged while the session lives."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), spec)
    if key not in _studies:
        twin = next((s for k, s in _studies.items() if k[:2] == key[:2]), None)
        _studies[key] = Study(spark, load_inputs(spark, sf_dir, spec), spec, twin)
    return _studies[key]


def forget(spark: SparkSession) -> None:
    """Drop the session's studies and their tables, so that changed inputs are read again."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _studies if k[0] == app]:
        _studies.pop(key).release()

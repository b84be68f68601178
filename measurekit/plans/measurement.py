"""The plan from verbatim rows to facts. Each step is a DataFrame built once.

Without a store nothing runs until a result is asked for. With a `TableStore` the steps many results start from are written as
tables when they are first used: the flagged events, the session status, the context and the session fact. Building a later step
then runs these jobs (`prepare` runs them all at once), later steps read a few columns of a table instead of repeating the
staging, and a lost executor costs a re-read, not a re-computation. The rows are the same either way.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from measurekit.config import Config
from measurekit.operators import facts as FA
from measurekit.operators import profiles as P
from measurekit.operators.checks import event_controls
from measurekit.operators.repeats import mark_repeats, repeat_groups
from measurekit.operators.rules_events import flag_events
from measurekit.operators.staging import stage_events, stage_observations
from measurekit.session import shared_dir


class TableStore:
    """Tables written once per store, in the shared folder of the cluster. Each store has a path of its own, made of the
    application, the source, the configuration and a run id, so stores of one source live side by side and nothing is overwritten."""

    def __init__(self, spark: SparkSession, source: str, root: str, cfg: Config | None = None):
        key = hashlib.sha256(f"{source}\n{cfg!r}".encode()).hexdigest()[:16]
        self.spark, self.path = spark, f"{root}/measurekit/{spark.sparkContext.applicationId}/{key}-{uuid.uuid4().hex}"
        self._written: set[str] = set()

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.path}/{name}"
        if name not in self._written:
            build().write.parquet(path)
            self._written.add(name)
        return self.spark.read.parquet(path)

    @staticmethod
    def for_source(spark: SparkSession, source: str, cfg: Config | None = None) -> TableStore | None:
        """A store in the shared folder, or None where there is none: then every step stays lazy. Results are the same."""
        root = shared_dir(spark)
        return None if root is None else TableStore(spark, source, root, cfg)


class Measurement:
    """The steps of one measurement over verbatim rows and, where given, context observations."""

    def __init__(self, raw: DataFrame, observations: DataFrame | None, cfg: Config, store: TableStore | None = None):
        self.raw, self.raw_observations, self.cfg, self.store = raw, observations, cfg, store

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step as a written table where there is a store, else as it is."""
        return build() if self.store is None else self.store.keep(name, build)

    def prepare(self) -> Measurement:
        """Write the shared tables now, so that building any later step runs no job."""
        for step in ("flagged", "session_flags", "versions", "sessions", "controls", "fact_session"):
            getattr(self, step)
        return self

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    @cached_property
    def flagged(self) -> DataFrame:
        """Staged events with repeat marks and event-rule flags."""
        def build() -> DataFrame:
            staged = stage_events(self.raw, self.cfg)
            # kept as a table, the few repeated groups have a known size: Spark broadcasts them only if they are small
            return flag_events(mark_repeats(staged, self.kept("repeat_groups", lambda: repeat_groups(staged))), self.cfg)

        return self.kept("events", build)

    @cached_property
    def staged(self) -> DataFrame:
        if self.store is None:
            return stage_events(self.raw, self.cfg)
        return self.flagged.drop(*[n for n in self.flagged.columns if n.startswith("hit_")], "is_repeat", "repeats_event_id")

    @cached_property
    def observations(self) -> DataFrame:
        return self.kept("observations", lambda: stage_observations(self.raw_observations))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.session_flags

    @cached_property
    def session_flags(self) -> DataFrame:
        """Session profiles with session rules and quarantine."""
        return self.kept("session_flags", lambda: P.flag_sessions(P.session_profiles(self.flagged, self.cfg), self.cfg))

    @cached_property
    def repeated_scales(self) -> DataFrame:
        return P.repeated_scales(self.flagged)

    @cached_property
    def version_pairs(self) -> DataFrame:
        return P.version_pairs(self.flagged, self.session_flags, self.cfg)

    @cached_property
    def versions(self) -> DataFrame:
        return self.kept("versions", lambda: P.compare_versions(self.version_pairs))

    @cached_property
    def sessions(self) -> DataFrame:
        """Session status with every rule and the rule ids by severity."""
        return self.kept("sessions", lambda: P.with_session_rules(self.session_flags, self.repeated_scales, self.versions, self.cfg))

    @cached_property
    def disposed(self) -> DataFrame:
        return FA.with_disposition(self.flagged, self.session_flags)

    @cached_property
    def controls(self) -> DataFrame:
        """Control sums of the events, from which all checks of events add up."""
        return self.kept("controls", lambda: event_controls(self.disposed))

    @cached_property
    def agreement(self) -> DataFrame:
        return FA.scale_day_agreement(FA.name_cells(self.staged))

    @cached_property
    def fact_event(self) -> DataFrame:
        return FA.fact_event(self.disposed, self.sessions, self.cfg)

    @cached_property
    def context(self) -> DataFrame:
        return self.kept("context", lambda: FA.fact_context(self.observations, self.cfg))

    @cached_property
    def fact_session(self) -> DataFrame:
        """Session facts with the name comparison and, where observations are given, the context."""
        def build() -> DataFrame:
            facts = FA.fact_session(self.sessions, self.cfg, FA.limited_sessions(self.disposed, self.agreement))
            return facts if self.raw_observations is None else FA.join_context(facts, self.context, self.cfg)

        return self.kept("fact_session", build)

    @property
    def facts(self) -> DataFrame:
        return self.fact_session

    @property
    def facts_with_context(self) -> DataFrame:
        if self.raw_observations is None:
            raise ValueError("the measurement has no observations")
        return self.fact_session

    @cached_property
    def fact_component(self) -> DataFrame:
        return FA.fact_component(self.disposed)

    @cached_property
    def volume(self) -> DataFrame:
        return FA.daily_volume(self.facts, self.cfg)

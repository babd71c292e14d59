"""One row for each URL: what the archives hold, what observers saw, what the events say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.evidence import flag_independent

COLUMNS = (
    "url_id original_url domain tld url_type entry_cohort first_observed first_appearance last_appearance temporal_span_days first_archive last_archive archives n_archives "
    "n_captures first_independent_appearance first_independent_archive independent_archives n_independent_archives n_observations n_observers current_state capture_gap "
    "preservation_gap witness_disagreement evidential_uncertainty content_survival n_content_changes first_content_change_at first_content_change_archive "
    "last_content_change_at last_content_change_archive"
).split()


def _first(value: str, time: str, where: Column | None = None) -> Column:
    """The value of the earliest time; of several, the smallest value. Rows without a value don't count."""
    return F.min_by(value, _ordered(value, time, where))


def _last(value: str, time: str, where: Column | None = None) -> Column:
    return F.max_by(value, _ordered(value, time, where))


def _ordered(value: str, time: str, where: Column | None) -> Column:
    usable = F.col(value).isNotNull() & F.col(time).isNotNull()
    return F.when(usable if where is None else usable & where, F.struct(time, value))


def _names(column: Column) -> Column:
    found = F.array_sort(F.collect_set(column))
    return F.when(F.size(found) > 0, found)


def capture_aggregates(captures: DataFrame, established: DataFrame) -> DataFrame:
    own = F.col("is_independent")
    flagged = flag_independent(captures, established, null_time=False)
    return flagged.groupBy("url_id").agg(
        F.min("capture_time").alias("first_appearance"),
        F.max("capture_time").alias("last_appearance"),
        _first("archive", "capture_time").alias("first_archive"),
        _last("archive", "capture_time").alias("last_archive"),
        _names(F.col("archive")).alias("archives"),
        F.size(F.collect_set("archive")).cast("bigint").alias("n_archives"),
        F.count(F.lit(1)).alias("n_captures"),
        F.min(F.when(own, F.col("capture_time"))).alias("first_independent_appearance"),
        _first("archive", "capture_time", own).alias("first_independent_archive"),
        _names(F.when(own, F.col("archive"))).alias("independent_archives"),
        F.size(F.collect_set(F.when(own, F.col("archive")))).cast("bigint").alias("n_independent_archives"),
    )


def observation_aggregates(observations: DataFrame) -> DataFrame:
    return observations.groupBy("url_id").agg(F.count(F.lit(1)).alias("n_observations"), F.size(F.collect_set("observer")).cast("bigint").alias("n_observers"))


def event_aggregates(events: DataFrame) -> DataFrame:
    is_type = lambda t: F.col("event_type") == t
    state, changed = F.col("event_type").startswith("state_"), F.col("event_type") == "content_changed"
    flag = lambda t: F.bool_or(is_type(t))
    return events.groupBy("url_id").agg(
        F.max_by("event_type", F.when(state, F.struct("event_end"))).alias("current_state"),
        flag("risk_capture_gap").alias("capture_gap"),
        flag("risk_preservation_gap").alias("preservation_gap"),
        flag("risk_witness_disagreement").alias("witness_disagreement"),
        flag("risk_evidential_uncertainty").alias("evidential_uncertainty"),
        flag("content_changed").alias("content_changed"),
        flag("content_stable").alias("content_stable"),
        F.sum(F.when(changed, F.col("evidence_count"))).cast("bigint").alias("n_content_changes"),
        F.min(F.when(changed, F.col("event_start"))).alias("first_content_change_at"),
        _first("archive", "event_start", changed).alias("first_content_change_archive"),
        F.max(F.when(changed, F.col("event_end"))).alias("last_content_change_at"),
        _last("archive", "event_end", changed).alias("last_content_change_archive"),
    )


def summary(urls: DataFrame, captures: DataFrame, observations: DataFrame, events: DataFrame, established: DataFrame) -> DataFrame:
    """Each input is reduced to a row a URL before it is joined, all on the same key."""
    joined = urls
    for side in (capture_aggregates(captures, established), observation_aggregates(observations), event_aggregates(events)):
        joined = joined.join(side, "url_id", "left")
    zero, false = F.lit(0).cast("bigint"), F.lit(False)
    survival = F.when(F.col("content_changed"), "changed").when(F.col("content_stable"), "stable").otherwise("unknown")
    return joined.withColumns(
        {
            "temporal_span_days": F.datediff("last_appearance", "first_appearance").cast("bigint"),
            "current_state": F.regexp_replace("current_state", "^state_", ""),
            "content_survival": survival,
            **{c: F.coalesce(c, zero) for c in ("n_observations", "n_observers", "n_content_changes")},
            **{c: F.coalesce(c, false) for c in ("capture_gap", "preservation_gap", "witness_disagreement", "evidential_uncertainty")},
        }
    ).select(*COLUMNS)

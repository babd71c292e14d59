"""From witnesses to states, risks and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.operators import evidence as E

STATES = ("S0", "S1", "S2", "S3", "S4")


def trajectory() -> Column:
    """Of a row of ``per_witness``: edited or replaced by the ratio of its first and last length; null if it doesn't say."""
    ratio = F.least("first_len", "last_len") / F.greatest("first_len", "last_len")
    return F.when(F.col("differs") & (F.col("n_len") >= 2), F.when(ratio < S.REPLACED_BELOW, "replaced").otherwise("edited"))


def per_url(witnesses: DataFrame, threshold: int = S.THRESHOLD, with_changes: bool = True) -> DataFrame:
    """(url_id, state, survival, trajectory, alive, n_inaccessible, witness_count, evidence_count, preserved, event_start, event_end)."""
    dead = E.is_inaccessible()
    aggregates = [
        F.coalesce(F.bool_or((F.col("kind") == "o") & (F.col("status") == S.ALIVE)), F.lit(False)).alias("alive"),
        F.size(F.collect_set(F.when(dead, F.struct("witness")))).alias("n_inaccessible"),
        F.size(F.collect_set(F.struct("witness"))).alias("witness_count"),
        F.sum("n").cast("int").alias("evidence_count"),
        F.bool_or(F.col("kind") == "c").alias("preserved"),
        F.min("min_t").alias("event_start"),
        F.max("max_t").alias("event_end"),
    ]
    if with_changes:
        path = trajectory()
        rank = F.struct(F.col("kind") == "c", F.col("witness").isNull(), "witness")
        aggregates += [
            F.coalesce(F.bool_or((F.col("n_dg") >= 2) & F.col("differs")), F.lit(False)).alias("changed"),
            F.coalesce(F.bool_or(F.col("n_dg") >= 2), F.lit(False)).alias("compared"),
            F.min_by(path, F.when(path.isNotNull(), rank)).alias("trajectory"),
        ]
    out = witnesses.groupBy("url_id").agg(*aggregates)
    if with_changes:
        out = out.withColumn("survival", F.when(F.col("changed"), "changed").when(F.col("compared"), "stable").otherwise("unknown")).drop("changed", "compared")
    else:
        out = out.withColumn("survival", F.lit("unknown")).withColumn("trajectory", F.lit(None).cast("string"))
    state = (
        F.when(F.col("alive") & (F.col("survival") == "changed") & (F.col("trajectory") == "edited"), "S1")
        .when(F.col("alive") & (F.col("survival") == "changed") & (F.col("trajectory") == "replaced"), "S2")
        .when(F.col("alive"), "S0")
        .when(F.col("n_inaccessible") >= threshold, "S3")
        .otherwise("S4")
    )
    return out.withColumn("state", state)


def with_risks(urls: DataFrame) -> DataFrame:
    state, preserved = F.col("state"), F.col("preserved")
    return urls.withColumns(
        {
            "capture_gap": (state != "S4") & ~preserved,
            "preservation_gap": (state == "S3") & ~preserved,
            "witness_disagreement": F.col("alive") & (F.col("n_inaccessible") > 0),
            "evidential_uncertainty": state == "S4",
        }
    )


RISKS = ("capture_gap", "preservation_gap", "witness_disagreement", "evidential_uncertainty")


def events(witnesses: DataFrame, threshold: int = S.THRESHOLD, with_changes: bool = True) -> DataFrame:
    """One state, a row for each risk, and either a change for each witness that saw one, or one "stable"."""
    urls = with_risks(per_url(witnesses, threshold, with_changes))
    kinds = [F.struct(F.lit(True).alias("on"), F.concat(F.lit("state_"), F.col("state")).alias("event_type"), F.when(F.col("state") == "S4", 0.5).otherwise(1.0).alias("confidence"))]
    kinds += [F.struct(F.col(r).alias("on"), F.lit(f"risk_{r}").alias("event_type"), F.lit(1.0).alias("confidence")) for r in RISKS]
    # Stable means that no series differs, so none has a transition.
    kinds += [F.struct((F.col("survival") == "stable").alias("on"), F.lit("content_stable").alias("event_type"), F.lit(1.0).alias("confidence"))]
    base = urls.select("*", F.inline(F.filter(F.array(*kinds), lambda k: k["on"]))).select(
        "url_id", "event_type", "event_start", "event_end", "confidence", F.col("evidence_count").cast("int"), F.col("witness_count").cast("int"), F.lit(None).cast("string").alias("archive")
    )
    if not with_changes:
        return base
    changes = witnesses.where("n_tr > 0").select(
        "url_id", F.lit("content_changed").alias("event_type"), F.col("first_old").alias("event_start"), F.col("last_new").alias("event_end"), F.lit(1.0).alias("confidence"),
        F.col("n_tr").cast("int").alias("evidence_count"), F.lit(1).alias("witness_count"), F.col("witness").alias("archive"),
    )
    return base.unionByName(changes)

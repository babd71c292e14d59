"""Classification and summary of what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold import schemas as S
from chronofold.operators import evidence as E
from chronofold.operators import lifecycle as L
from chronofold.plans import summary as Y
from chronofold.sources.store import Store


def classify(store: Store, years: dict[str, int], threshold: int = S.THRESHOLD, with_changes: bool = True) -> int:
    """Replace the events; returns the URLs classified. Without evidence the old events stay."""
    est = E.established_table(store.spark, years)
    witnesses = E.per_witness(E.evidence(store.read("observations"), store.read("captures"), est), with_changes)
    if not store.replace("events", L.events(witnesses, threshold, with_changes)):
        return 0
    return store.read("events").where(F.col("event_type").startswith("state_")).count()


def summarize(store: Store, years: dict[str, int]) -> int:
    est = E.established_table(store.spark, years)
    return store.write_summary(Y.summary(store.read("urls"), store.read("captures"), store.read("observations"), store.read("events"), est))

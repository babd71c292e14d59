"""An extension: captures that arrive as new parts re-classify only the URLs they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold import schemas as S
from chronofold.operators import evidence as E
from chronofold.operators import lifecycle as L
from chronofold.sources.store import Store


def reclassify(store: Store, touched: DataFrame, years: dict[str, int], threshold: int = S.THRESHOLD, with_changes: bool = True) -> DataFrame:
    """The events of the touched URLs, from all their stored evidence."""
    ids = touched.select("url_id").distinct()
    mine = lambda table: store.read(table).join(ids, "url_id", "left_semi")
    witnesses = E.per_witness(E.evidence(mine("observations"), mine("captures"), E.established_table(store.spark, years)), with_changes)
    return L.events(witnesses, threshold, with_changes)


def watch(store: Store, years: dict[str, int], checkpoint: str, threshold: int = S.THRESHOLD) -> StreamingQuery:
    """A stream over the captures' parts; each batch lays the events of its URLs over the stored ones, which aren't rewritten."""

    def batch(df: DataFrame, _: int) -> None:
        store.overlay("events", df, reclassify(store, df, years, threshold))

    source = store.spark.readStream.schema(S.TABLES["captures"]).option("pathGlobFilter", "*.parquet").parquet(store.path("captures"))
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def capture_rates(captures: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Captures by archive and window of a stream, with late rows up to a bound."""
    return captures.withWatermark("capture_time", late).groupBy(F.window("capture_time", window), "archive").agg(F.count(F.lit(1)).alias("n"))

"""Raw answers as compressed JSON lines, a folder for each witness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a segment before compression; what a record has besides its payload.
SEGMENT, FRAME = 256 << 20, 120


def storable(payload: Column) -> Column:
    """An answer without its body, where it has one: of live pages only the length is kept."""
    parsed = F.from_json(payload, "map<string,string>")
    slim = F.map_concat(F.map_filter(parsed, lambda k, _: k != "body"), F.create_map(F.lit("body_length"), F.length(F.element_at(parsed, "body")).cast("string")))
    return F.when(F.map_contains_key(parsed, "body"), F.to_json(slim)).otherwise(payload)


def append(df: DataFrame, out: str) -> None:
    """(url_id, witness, stored_at, payload); empty payloads are passed over."""
    some = df.where(F.trim(F.coalesce("payload", F.lit(""))).isin("", "[]", "{}") == F.lit(False))
    rows = some.select("url_id", "witness", "stored_at", storable(F.col("payload")).alias("payload"))
    # Files are cut by records, so their number follows from the mean size.
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    rows.write.mode("append").partitionBy("witness").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(SEGMENT / (mean + FRAME)))).json(f"{out.rstrip('/')}/raw")


def read(spark, out: str) -> DataFrame:
    return spark.read.schema("url_id string, stored_at timestamp, payload string, witness string").json(f"{out.rstrip('/')}/raw")

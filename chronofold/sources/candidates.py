"""Lists of URLs to watch: CSV files and compressed index lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources import files

COLUMNS = ("url", "first_observed_year", "url_type", "file_ord", "line_ord")


def expand(spark: SparkSession, path: str) -> list[str]:
    """A directory's CSV files and then its compressed ones, each sorted; a file is itself."""
    if not files.is_dir(spark, path):
        return [path]
    return files.names(spark, f"{path.rstrip('/')}/*.csv") + files.names(spark, f"{path.rstrip('/')}/*.gz")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Needs a header with ``url``; year and type may be absent.

    Cells may hold line ends, so a file is read by one task; large lists come as many files.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "url" not in raw.columns:
        raise ValueError(f"{path} has no column url")
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    kind = F.lower(F.trim(cell("url_type")))
    return raw.withColumn("line_ord", F.monotonically_increasing_id()).select(
        F.trim("url").alias("url"), F.trim(cell("first_observed_year")).alias("first_observed_year"), F.when(kind == "", "unknown").otherwise(kind).alias("url_type"), "line_ord"
    ).where(F.coalesce("url", F.lit("")) != "")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a leading field, key, time and URL; a sixth field of digits that is no 2xx status drops the line."""
    f = F.split(F.trim("value"), r"\s+")
    name = path.rsplit("/", 1)[-1]
    kind = "root" if "root" in name else "deep" if "deep" in name else "unknown"
    status = F.get(f, F.lit(5))
    dropped = (F.size(f) >= 6) & status.rlike("^[0-9]+$") & ~status.startswith("2")
    return spark.read.text(path).withColumn("line_ord", F.monotonically_increasing_id()).where((F.size(f) >= 4) & ~F.coalesce(dropped, F.lit(False))).select(
        F.get(f, F.lit(3)).alias("url"), F.substring(F.get(f, F.lit(2)), 1, 4).alias("first_observed_year"), F.lit(kind).alias("url_type"), "line_ord"
    )


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files' rows; ``file_ord`` and ``line_ord`` keep their order."""
    found = [p for path in paths for p in expand(spark, path)]
    if not found:
        raise ValueError(f"no .csv or .gz files in {', '.join(paths)}")
    each = [(read_index if p.endswith(".gz") else read_csv)(spark, p).withColumn("file_ord", F.lit(i)) for i, p in enumerate(found)]
    return reduce(DataFrame.unionByName, each).select(*COLUMNS)

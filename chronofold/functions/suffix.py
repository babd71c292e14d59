"""Public suffixes, by the rule list that comes with Spark's own HTTP client.

The list is read at run time (ICANN section), not copied: through the JVM's class loader, or
else from the jar. Where it can't be found that is an error, never an empty list. The rules, some ten
thousand at most, go to every task; hosts are made distinct first.
"""

from __future__ import annotations

import logging
import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import urls as U

_LIST = "mozilla/public-suffix-list.txt"
MOST_RULES = 50_000
#: The rules, once they have been read.
_KNOWN: list[tuple[tuple[str, int], ...]] = []


def _jars() -> Iterator[Path]:
    """Where Spark's jars may lie, apart from what its JVM has loaded."""
    homes = [Path(pyspark.__file__).parent, *(Path(h) for h in [os.environ.get("SPARK_HOME")] if h)]
    for home in homes:
        yield from sorted((home / "jars").glob("*httpclient*.jar"))


def list_text(spark: SparkSession) -> str:
    """The list, as the JVM's class loader or else a jar has it. Without one no suffix is known, which is an error."""
    asks = (
        lambda: spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(_LIST),
        lambda: spark._jvm.java.lang.ClassLoader.getSystemResourceAsStream(_LIST),
    )
    for ask in asks:
        try:
            stream = ask()
            if stream is not None:
                return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Exception as e:  # a session without a JVM of its own, or one that doesn't let it be asked
            logging.getLogger(__name__).info("the JVM gives no suffix list: %s", e)
    for jar in _jars():
        with zipfile.ZipFile(jar) as z:
            if _LIST in z.namelist():
                return z.read(_LIST).decode("utf-8")
    raise FileNotFoundError(f"no public suffix list: neither the JVM nor the jars of Spark's HTTP client have {_LIST}")


def parse_rules(text: str) -> tuple[tuple[str, int], ...]:
    """(rule, kind): 0 plain, 1 the base of a wildcard, 2 an exception; international ones in both spellings."""
    out = set()
    for line in text.partition("===END ICANN DOMAINS===")[0].splitlines():
        rule = line.strip()
        if rule and not rule.startswith("//"):
            kind = 1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0
            rule = rule.removeprefix("*.").removeprefix("!")
            out.add((rule, kind))
            if not rule.isascii():
                out.add((rule.encode("idna").decode(), kind))
    if not out:
        raise ValueError("the public suffix list has no rule")
    if len(out) > MOST_RULES:
        raise ValueError(f"{len(out)} suffix rules are too many to send to every task")
    return tuple(sorted(out))


def rules(spark: SparkSession) -> tuple[tuple[str, int], ...]:
    if not _KNOWN:
        _KNOWN.append(parse_rules(list_text(spark)))
    return _KNOWN[0]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules(spark)), "rule string, kind int")


def with_suffix(df: DataFrame, domain: Column, out: str = "tld") -> DataFrame:
    """Adds the public suffix of a domain with a dot before it, or an empty text if no rule fits."""
    host = F.regexp_replace(U.hostname(domain), r"\.+$", "")
    keyed = df.withColumn("__host", F.coalesce(host, F.lit("")))
    labels = F.split("__host", r"\.")
    hosts = keyed.select("__host").where("__host <> ''").distinct().withColumn("__labels", labels)
    tails = hosts.select("__host", "__labels", F.posexplode(F.transform("__labels", lambda _, i: F.array_join(F.slice("__labels", i + 1, F.size("__labels")), "."))).alias("__i", "__tail"))
    hit = tails.join(F.broadcast(rule_table(df.sparkSession)), F.col("__tail") == F.col("rule"))
    # Where a suffix starts: at the tail, a label before it for a wildcard, a label after for an exception, which wins.
    at = F.col("__i") + F.when(F.col("kind") == 1, -1).when(F.col("kind") == 2, 1).otherwise(0)
    best = hit.withColumn("__at", at).where("__at >= 0").groupBy("__host").agg(
        F.coalesce(F.min(F.when(F.col("kind") == 2, F.col("__at"))), F.min("__at")).alias("__at"), F.first("__labels").alias("__labels")
    )
    found = best.select(F.col("__host").alias("__host2"), F.concat(F.lit("."), F.array_join(F.slice("__labels", F.col("__at") + 1, F.size("__labels")), ".")).alias("__suffix"))
    joined = keyed.join(found, F.col("__host") == F.col("__host2"), "left")
    return joined.select(*df.columns, F.coalesce("__suffix", F.lit("")).alias(out))

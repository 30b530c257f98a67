"""Hourly event files: JSON-lines scan (A1), filtered sink (A5), re-ingest.

The scan passes an explicit schema (no inference pass over the data) and
keeps malformed lines in ``_corrupt_record`` so they can be dropped without
failing the job. Gzip files are not splittable, so one file is one task; the
normaliser's output is repartitioned by ``id`` before any keyed work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_EVENT

# Microsecond timestamps in the files (Spark's default keeps milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_event_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw archive lines -> nested rows; malformed and blank lines dropped."""
    df = (spark.read.schema(RAW_EVENT)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .option("timestampNTZFormat", TS_FORMAT)
          .json(path))
    # A line that parsed into nothing (e.g. "{}" or a bare value) has no id.
    return df.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")


def write_event_lines(raw: DataFrame, path: str, compression: str = "gzip") -> None:
    """Filtered JSON-lines sink partitioned by UTC day and hour (A5).

    ``raw`` is in the nested archive shape. Re-running for the same hours
    replaces only those hour partitions (dynamic partition overwrite). The
    ``REBALANCE`` hint gives about one file per hour, and AQE splits an hour
    holding many rows over several tasks.
    """
    (raw.withColumn("event_date", F.to_date("created_at"))
        .withColumn("hour", F.hour("created_at"))
        .hint("rebalance", "event_date", "hour")
        .sortWithinPartitions("event_date", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .option("timestampNTZFormat", TS_FORMAT)
        .partitionBy("event_date", "hour")
        .json(path))


def read_golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases stored as one multi-line JSON array."""
    from ..schemas import GOLDEN_CASE
    return spark.read.schema(GOLDEN_CASE).option("multiLine", True).json(path)


def write_golden_cases(cases: DataFrame, path: str) -> None:
    """Golden cases as multi-line JSON arrays, one array per part file."""
    line = F.to_json(F.struct(*cases.columns))
    part = F.pmod(F.xxhash64("line"), F.lit(16)).alias("part")
    parts = cases.select(line.alias("line")).groupBy(part).agg(
        F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("line")), ",\n"), F.lit("\n]")).alias("value"))
    parts.write.mode("overwrite").partitionBy("part").text(path)

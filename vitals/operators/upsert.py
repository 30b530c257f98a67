"""Keyed upserts over immutable files, expressed as set operations.

* ``upsert_ignore``   ON CONFLICT (key) DO NOTHING — existing rows win, and
  inside the batch the earliest row (by ``order_col``) wins.
* ``upsert_replace``  ON CONFLICT (key) DO UPDATE all columns — batch wins.
* ``upsert_partial``  ON CONFLICT DO UPDATE of some columns only — the
  updatable columns take the latest version, the others keep the first.

All three shuffle once on the key; none collects anything to the driver. For
file tables partitioned by a date column, ``write_replace`` overwrites only
the partitions present in the batch (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order_cols: list[str]) -> DataFrame:
    """Deterministic ``dropDuplicates``: the first row per key by ``order_cols``.

    The filter on ``row_number`` keeps one row per key and task before the shuffle
    (``WindowGroupLimit``), so duplicates of a hot key are not sent.
    """
    w = Window.partitionBy(*key).orderBy(*order_cols)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert_ignore(target: DataFrame, batch: DataFrame, key: list[str],
                  order_cols: list[str]) -> DataFrame:
    """Insert-if-absent: target plus batch rows whose key is new."""
    fresh = first_per_key(batch, key, order_cols).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_replace(target: DataFrame, batch: DataFrame, key: list[str],
                   order_cols: list[str] | None = None) -> DataFrame:
    """Replace-on-key: batch rows replace target rows with the same key."""
    b = first_per_key(batch, key, order_cols) if order_cols else batch
    kept = target.join(b.select(*key), key, "left_anti")
    return kept.unionByName(b.select(*target.columns))


def upsert_partial(versions: DataFrame, key: list[str], version_col: str,
                   update_cols: list[str]) -> DataFrame:
    """Fold all versions of a row: ``update_cols`` from the latest version,
    every other column from the first one (NULL values are kept as values)."""
    others = [c for c in versions.columns if c not in key and c not in update_cols and c != version_col]
    newest = Window.partitionBy(*key).orderBy(F.col(version_col).desc())
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one shuffle and one sort: the newest row, with the other columns of the oldest
    out = versions.withColumn("_place", F.row_number().over(newest)).withColumn(
        "_oldest", F.last(F.struct(*others)).over(whole)).where("_place = 1")
    return out.select(*[F.col(f"_oldest.{c}").alias(c) if c in others else F.col(c) for c in versions.columns])


def write_replace(df: DataFrame, path: str, partition_col: str = "date") -> None:
    """Sink for ``upsert_replace`` on a file table: overwrite only the
    partitions present in ``df``."""
    (df.sortWithinPartitions(partition_col).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).parquet(path))

"""Versions: a log of (record_id, commit_ts, deleted, fields...), what is visible in it, and writes.

Each function is one plan over the log. Latest-per-key is an aggregate with map-side combine, so a
record with many versions costs no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = ("record_id", "commit_ts", "deleted")


def snapshot(log: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """The records visible at a time, or the latest; without system columns but ``record_id`` and ``commit_ts``."""
    if as_of is not None:
        log = log.filter(F.col("commit_ts") <= as_of)
    rest = [c for c in log.columns if c != "record_id"]
    last = log.groupBy("record_id").agg(F.max_by(F.struct(*rest), F.col("commit_ts")).alias("v"))
    return last.select("record_id", "v.*").filter(~F.col("deleted")).drop("deleted")


def overlay(visible: DataFrame, puts: DataFrame, deletes: DataFrame) -> DataFrame:
    """What a transaction sees: the snapshot without the keys it staged, and its own records."""
    staged = puts.select("record_id").unionByName(deletes.select("record_id"))
    return visible.join(staged, "record_id", "left_anti").unionByName(puts, allowMissingColumns=True)


def conflicts(log: DataFrame, written: DataFrame, read_ts: int | Column) -> DataFrame:
    """Keys written by others since ``read_ts``: the first to commit wins."""
    return written.select("record_id").distinct().join(log.filter(F.col("commit_ts") > read_ts), "record_id", "left_semi")


def survivors(log: DataFrame, cutoff: int | Column, keep: int = 1) -> DataFrame:
    """What garbage collection keeps: versions seen at or after ``cutoff``, the latest ``keep``, no dead tombstones."""
    newest = Window.partitionBy("record_id").orderBy(F.col("commit_ts").desc())
    numbered = log.withColumn("nth", F.row_number().over(newest)).withColumn("superseded", F.lag("commit_ts").over(newest))
    kept = numbered.filter((F.col("nth") <= keep) | F.col("superseded").isNull() | (F.col("superseded") > cutoff))
    # superseded is null for the latest only; a tombstone that is latest and old ends its record
    dead = numbered.filter((F.col("nth") == 1) & F.col("deleted") & (F.col("commit_ts") <= cutoff)).select("record_id")
    return kept.join(dead, "record_id", "left_anti").drop("nth", "superseded")


def upserted(visible: DataFrame, records: DataFrame) -> DataFrame:
    """The collection after whole records were inserted or replaced by key."""
    return visible.join(records.select("record_id"), "record_id", "left_anti").unionByName(records, allowMissingColumns=True)


def updated(visible: DataFrame, hit: Column, changes: dict[str, Column]) -> DataFrame:
    """The matching records with top-level fields set; the others as they are."""
    hit = F.coalesce(hit, F.lit(False))
    return visible.withColumns({n: F.when(hit, c).otherwise(F.col(n)) if n in visible.columns else F.when(hit, c) for n, c in changes.items()})


def deleted(visible: DataFrame, hit: Column) -> DataFrame:
    return visible.filter(~F.coalesce(hit, F.lit(False)))


# --------------------------------------------------------------------------- integrity


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of values of a unique field that occur more than once; nulls are exempt."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def taken(records: DataFrame, visible: DataFrame, column: str) -> DataFrame:
    """Records whose unique value another record has."""
    others = visible.select(F.col(column).alias("value"), F.col("record_id").alias("holder"))
    return records.join(others, (records[column] == others["value"]) & (records["record_id"] != others["holder"]), "left_semi")


def dangling(df: DataFrame, link: str, target: DataFrame, target_key: str) -> DataFrame:
    """Records whose link names no target; a null link names none and is allowed."""
    side = target.select(F.col(target_key).alias("link_key"))
    return df.filter(F.col(link).isNotNull()).join(side, df[link] == side["link_key"], "left_anti")


def referred(target: DataFrame, target_key: str, df: DataFrame, link: str) -> DataFrame:
    """Targets that some record links to: these can't be deleted under ``restrict``."""
    side = df.select(F.col(link).alias("link_key"))
    return target.join(side, target[target_key] == side["link_key"], "left_semi")

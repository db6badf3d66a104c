"""Statistics of a collection, the estimate of a schema change, and consistency of stored postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.catalog import Schema
from siltstone.sources.files import cut


def statistics(df: DataFrame, indexed: list[str], texts: list[str] = (), vectors: list[str] = ()) -> DataFrame:
    """One row: records, distinct non-null values of indexed fields, non-blank texts, vectors, mean JSON size."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in indexed],
        *[F.count_if(F.length(F.trim(c)) > 0).alias(f"texts_{c}") for c in texts],
        *[F.count(c).alias(f"vectors_{c}") for c in vectors],
        F.round(F.avg(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))), 3).alias("avg_size"),
    )


def migration(df: DataFrame, now: Schema, target: Schema) -> dict:
    """Fields and indexes that a new schema adds or removes, and how many records break it."""
    old, new = {f.name: f for f in now.fields}, {f.name: f for f in target.fields}
    failing = df.filter(target.violation(df).isNotNull())
    return {
        "added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()),
        "new_indexes": sorted(n for n, f in new.items() if (f.indexed or f.unique) and not (n in old and (old[n].indexed or old[n].unique))),
        "vector_indexes": sorted(n for n, f in new.items() if f.type == "vector"),
        "failing": failing,
        "warnings": sorted(f"type of {n} changes" for n in new.keys() & old.keys() if new[n].type != old[n].type),
    }


#: Keys whose entries differ that are sent to every executor; more are joined by a shuffle.
FEW = 100_000


def only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of these keys, of which null may be one."""
    return df.join(keys, df[key].eqNullSafe(keys[key]), "left_semi")


def inconsistent(stored: DataFrame, rebuilt: DataFrame, key: str, narrow: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Entries that only one side has.

    The entries of each key are counted and hashed to 128 bits first, in the tasks that make them; only those
    of keys where the sides differ are compared one by one. ``narrow`` makes both sides for some keys alone.
    """
    on = [c for c in stored.columns if c in rebuilt.columns]

    def prints(df: DataFrame, name: str) -> DataFrame:
        hashes = [F.bit_xor(F.xxhash64(*seed, *on)).alias(f"x{i}") for i, seed in enumerate(([], [F.lit("second")]))]
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *hashes).select(key, F.struct("n", "x0", "x1").alias(name))

    differ = cut(prints(stored, "a").join(prints(rebuilt, "b"), key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(key))
    differ = F.broadcast(differ) if differ.count() <= FEW else differ
    stored, rebuilt = (cut(df) for df in (narrow(differ) if narrow else (only(stored, key, differ), only(rebuilt, key, differ))))
    return stored.join(rebuilt, on, "left_anti").select(*on).unionByName(rebuilt.join(stored, on, "left_anti").select(*on))


def fingerprint(df: DataFrame, key: str, version: str) -> DataFrame:
    """One number for the content: independent of order, changed by any record or version."""
    return df.agg(F.coalesce(F.bit_xor(F.xxhash64(key, version)), F.lit(0)).alias("fingerprint"))

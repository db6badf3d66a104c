"""A stored full-text index: postings, terms and document lengths as Parquet, and a manifest that makes them count.

Postings are ordered by term and key in files of a range each, so that a query reads the row groups of
its terms alone; a term that very many documents have spreads over several files. Each posting has its
document's length, and the manifest the statistics, so that ranking needs neither the texts nor a join.

An index whose manifest is there and fits is loaded; otherwise it is built anew, in a folder of its own
that counts once the manifest is written. Indexes of files are found by a pointer that is named by
their content; whoever builds one puts it there last, so that builders don't meet.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.sources.files import Files, cut, shared_dir, size_of, version_of

#: Changed whenever terms or tables are made in another way.
FORMAT = 1


@dataclass
class TextIndex:
    """``documents``, ``terms`` and ``words`` count documents with tokens, distinct terms and all tokens."""

    spark: SparkSession
    path: str
    key: str
    documents: int
    terms: int
    words: int
    loaded: bool

    @property
    def postings(self) -> DataFrame:
        """(term, key, tf, dl)."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def vocabulary(self) -> DataFrame:
        """(term, df)."""
        return self.spark.read.parquet(f"{self.path}/terms")

    @property
    def lengths(self) -> DataFrame:
        """(key, dl) of the documents that have tokens."""
        return self.spark.read.parquet(f"{self.path}/lengths")

    @property
    def mean(self) -> float:
        return max(1.0, self.words / self.documents) if self.documents else 1.0

    def drop(self) -> None:
        Files(self.spark).remove(self.path)


#: Bytes of files up to which texts are dealt to all cores before they are split: small tables often are one row group.
SMALL = 256 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is small."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if 0 < size_of(df) <= SMALL else df


def unique(df: DataFrame, key: str) -> bool:
    """Whether each row has a key of its own."""
    return df.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty()


def tokenized(df: DataFrame, key: str, column: str, analyzer: str = "default") -> DataFrame:
    """(key, own): the terms of each key's text, a row for each key. Only where rows share a key are they shuffled."""
    split = dealt(df.select(*dict.fromkeys((key, column)))).select(key, T.terms(F.col(column), analyzer).alias("own"))
    return split if unique(df, key) else split.groupBy(key).agg(F.flatten(F.collect_list("own")).alias("own"))


def runs(own: DataFrame, *keep: str) -> DataFrame:
    """(*keep, term, tf) from (*keep, own): each term of a row and how often it is there, without a shuffle."""
    # exploding an array of one keeps Catalyst from making it again for each use
    held = own.select(*keep, F.explode(F.array(F.sort_array("own"))).alias("own")).filter(F.size("own") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i == 0) | (F.get(F.col("own"), i) != F.get(F.col("own"), i - 1)))
    held = held.select(*keep, "own", F.explode(F.array(first)).alias("first"))
    several = F.transform("first", lambda i, n: F.struct(F.get(F.col("own"), i).alias("term"), (F.coalesce(F.get(F.col("first"), n + 1), F.size("own")) - i).cast("bigint").alias("tf")))
    return held.select(*keep, F.explode(several).alias("x")).select(*keep, "x.term", "x.tf")


def counted(df: DataFrame, key: str, column: str) -> DataFrame:
    """(term, key, tf, dl) of texts: the default analyzer's tokens, one pass over the texts."""
    return runs(tokenized(df, key, column).select(key, F.size("own").alias("dl"), "own"), key, "dl").select("term", key, "tf", "dl")


def lengths(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dl) of the texts that have tokens."""
    return tokenized(df, key, column).select(key, F.size("own").alias("dl")).filter("dl > 0")


def _write(spark: SparkSession, made: DataFrame, sizes: DataFrame, path: str, key: str, loaded: bool = False) -> TextIndex:
    made.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")
    documents, words = spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    terms = spark.read.parquet(f"{path}/terms").count()
    Files(spark).replace(f"{path}/manifest.json", json.dumps({"format": FORMAT, "key": key, "documents": documents, "terms": terms, "words": words}))
    return TextIndex(spark, path, key, documents, terms, words, loaded)


def load(spark: SparkSession, path: str) -> TextIndex | None:
    """The index in a folder; None where there is none, or one of another format, or a part of it is gone."""
    files = Files(spark)
    held = files.read(f"{path}/manifest.json")
    if held is None or not all(files.exists(f"{path}/{part}/_SUCCESS") for part in ("postings", "terms", "lengths")):
        return None
    m = json.loads(held)
    return TextIndex(spark, path, m["key"], m["documents"], m["terms"], m["words"], True) if m.get("format") == FORMAT else None


def build(df: DataFrame, key: str, column: str, path: str) -> TextIndex:
    return _write(df.sparkSession, counted(df, key, column), lengths(df, key, column), path, key)


@dataclass
class Texts:
    """In the place of an index: a frame that has the texts of a joined collection by themselves, so that only they are read."""

    df: DataFrame


def held(df: DataFrame, key: str, column: str) -> TextIndex | None:
    """The index of a column where one of this content is in the shared folder; none is built."""
    pointer = pointer_of(df, key, column)
    path = Files(df.sparkSession).read(pointer) if pointer else None
    return load(df.sparkSession, path) if path is not None else None


def open_index(df: DataFrame, key: str, column: str, folder: str | None = None, version: str | None = None) -> TextIndex:
    """The index of a column: loaded where one of this content is in ``folder`` (by default the shared one), else built there.

    Content without files or a ``version`` can't be told from other, and is indexed each time.
    """
    spark, files = df.sparkSession, Files(df.sparkSession)
    pointer = pointer_of(df, key, column, folder, version)
    held = files.read(pointer) if pointer else None
    if held is not None and (made := load(spark, held)) is not None:
        return made
    made = build(df, key, column, f"{folder or shared_dir(spark) + '/text-index'}/{uuid.uuid4().hex}")
    if pointer:
        files.replace(pointer, made.path)
    return made


def pointer_of(df: DataFrame, key: str, column: str, folder: str | None = None, version: str | None = None) -> str | None:
    """The file that names the folder of the index of this content."""
    version = version or version_of(df.select(key, column))
    return f"{folder or shared_dir(df.sparkSession) + '/text-index'}/{version}-{key}-{column}.path" if version else None


def maintained(index: TextIndex, gone: DataFrame, new: DataFrame, column: str, path: str) -> TextIndex:
    """The index after some documents went (by key) and others came or changed: only these are read as texts."""
    key = index.key
    changed = gone.select(key).unionByName(new.select(key)).distinct()
    kept, sizes = (df.join(changed, key, "left_anti") for df in (index.postings, index.lengths))
    return _write(index.spark, cut(kept.unionByName(counted(new, key, column))), cut(sizes.unionByName(lengths(new, key, column))), path, key)

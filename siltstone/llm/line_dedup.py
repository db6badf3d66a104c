"""Line dedup: later occurrences of windows of three consecutive lines are removed.

Every window of three lines is hashed to 128 bits. The first occurrence of each, in the order of
(doc_id, line), is found by an aggregate that combines before the shuffle; windows are joined with it,
where Spark splits the hot ones, and all but the first are repeats. The lines that repeats cover, merged,
go. No task holds all occurrences of a window.

Defined results
* null text stays null, with no line removed; a text of fewer than three lines has no window.
* a window of three blank lines isn't counted.
* rows of the same doc_id and text are one document, and all of them get the same result; rows of
  the same doc_id and other texts are ordered by a hash of the text.
* a null doc_id comes before all others.
* an empty table gives an empty table; further columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, fresh, loose

WINDOW = 3


def covered_lines(docs: DataFrame) -> DataFrame:
    """(k_doc, k_row, starts): where repeated windows begin in a document, by line number from 0, in order."""
    lines = docs.select(
        docs["doc_id"].alias("k_doc"),
        F.xxhash64(docs["text"]).alias("k_row"),
        F.split(docs["text"], "\n", -1).alias("lines"),
    ).filter(F.size("lines") >= WINDOW)
    windows = cut(  # read twice
        lines.select("k_doc", "k_row", F.posexplode(F.expr(
            "transform(sequence(0, size(lines) - 3), i -> struct("
            "xxhash64(lines[i], lines[i + 1], lines[i + 2]) AS a, "
            "xxhash64(1, lines[i + 2], lines[i + 1], lines[i]) AS b, "
            "length(trim(concat(lines[i], lines[i + 1], lines[i + 2]))) > 0 AS full))"
        )).alias("at", "w"))
        .filter("w.full")
        .select("k_doc", "k_row", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    )
    place = F.struct("k_doc", "k_row", "at")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(loose(first, "a", "b"), ["a", "b"]).filter(place > F.col("first"))
    return later.groupBy("k_doc", "k_row").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def without(lines: Column, starts: Column) -> tuple[Column, Column]:
    """(the lines outside of the windows that begin at ``starts``, how many are inside)."""
    n = F.size(lines)
    after = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + WINDOW))
    until = F.concat(starts, F.array(n))
    gaps = F.transform(F.arrays_zip(after.alias("a"), until.alias("u")), lambda x: F.struct(x["a"].alias("a"), F.greatest(x["u"] - x["a"], F.lit(0)).alias("n")))
    kept = F.flatten(F.transform(F.filter(gaps, lambda x: x["n"] > 0), lambda x: F.slice(lines, x["a"] + 1, x["n"])))
    return kept, n - F.aggregate(gaps, F.lit(0), lambda total, x: total + x["n"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that stays, and ``n_removed``: the number of lines taken out."""
    removed = fresh(docs.columns, "n_removed")
    names = {c: fresh([*docs.columns, removed], c) for c in ("k_doc", "k_row", "starts")}
    gone = covered_lines(docs).select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = docs.join(
        gone,
        docs["doc_id"].eqNullSafe(gone[names["k_doc"]]) & (F.xxhash64(docs["text"]) == gone[names["k_row"]]),
        "left",
    )
    starts = gone[names["starts"]]
    kept, n = without(F.split(docs["text"], "\n", -1), starts)
    return joined.select(
        *[F.when(starts.isNull(), docs[c]).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else docs[c] for c in docs.columns],
        F.when(starts.isNull(), F.lit(0)).otherwise(n).cast("long").alias(removed),
    )


def stage(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the deduplicated text; a document left without text goes."""
    out = dedup_lines(docs)
    n = out.columns[-1]
    return out.filter((out[n] == 0) | (F.length(F.trim(out["text"])) > 0)).drop(n)


SQL_WINDOWS = """
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {docs} WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, text, i AS pos, concat_ws(chr(10), l[i + 1], l[i + 2], l[i + 3]) AS w
  FROM (SELECT doc_id, text, l, unnest(range(0, len(l) - 2)) AS i FROM lines WHERE len(l) >= 3)
  WHERE length(trim(concat(l[i + 1], l[i + 2], l[i + 3]))) > 0),
later AS (
  SELECT doc_id, pos FROM windows
  QUALIFY dense_rank() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT n) AS g
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS n FROM later) GROUP BY doc_id),
deduped AS (
  SELECT d.doc_id,
    CASE WHEN g IS NULL THEN d.text
         ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g, i - 1)), chr(10)), '')
    END AS text,
    coalesce(len(g), 0) AS n_removed
  FROM {docs} d LEFT JOIN gone USING (doc_id))"""

SQL = "WITH " + SQL_WINDOWS.format(docs="documents") + " SELECT doc_id, text, n_removed FROM deduped"

"""Line dedup over overlapping windows of lines, in DataFrame functions only.

Every window of consecutive lines is hashed; windows that occur again anywhere are found globally; each
occurrence after the first gives up its lines, overlapping windows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3


def _marked(docs: DataFrame, window: int) -> DataFrame:
    """``row`` (the whole input row), ``lines`` (null for a null text), ``gone`` (sorted positions, null if none)."""
    # the row travels as one struct, so no column of the table can clash with those used here
    own = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64("doc_id", "text").alias("print"),
        F.split("text", "\n").alias("lines"),
    )
    keys = own.filter(F.size("lines") >= window).select("id", "print", "lines")
    parts = ", ".join(f"lines[i + {k}]" for k in range(window))
    hashes = F.expr(f"transform(sequence(0, size(lines) - {window}), i -> struct(xxhash64({parts}) AS a, xxhash64(1, {parts}) AS b))")
    windows = keys.select("id", "print", F.posexplode(hashes).alias("at", "hash")).select("id", "print", "at", "hash.a", "hash.b")

    place = F.struct("id", "print", "at")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written, so that both sides of the join come from shuffles of their own and a hot window can be split
    first = common.kept(first, "windows")
    later = windows.join(first, ["a", "b"]).filter(place != F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda p: F.sequence(p, p + (window - 1))))))
    # written for the same reason: a row repeated very often meets it in the join below
    gone = common.kept(later.groupBy("id", "print").agg(covered.alias("gone")), "gone").hint("merge")  # one plan at every size
    # lines are split again after the join, so that the shuffle carries each text once
    return own.drop("lines").join(gone, ["id", "print"], "left").select("row", F.split("row.text", "\n").alias("lines"), "gone")


def _kept():
    """The text without its covered lines; as it was where none is covered."""
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    return F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns and rows; ``text`` loses the later occurrences of repeated windows.

    Lines are what newlines separate. Occurrences are ordered by ``doc_id`` (null first), a hash of id and text, and position; the
    first stays, within one document too. Null texts stay null; empty texts and those with fewer lines than a
    window stay as they are; a text that loses all lines becomes empty. Rows that repeat id and text count as one document
    and come out alike. An empty table gives an empty result. Columns beyond ``doc_id`` and ``text`` pass through under
    any name. Windows are compared by 128 bits of hash.
    """
    out = _marked(docs, window).withColumn("kept", _kept())
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_lines, n_removed, text``: line counts and the text that stays."""
    return _marked(docs, window).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        _kept().alias("text"),
    )


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w WHERE win IS NOT NULL
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, k.text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

"""Line dedup: lines that many documents share stay in one document only.

A text is cut at ``\\n``. A line's key is the line without the characters of ``SPACE`` at either
end, A-Z lower-cased; keys travel as 128 bits of hash. A key of at least ``min_chars`` code points
that stands in at least ``min_docs`` documents loses all its lines except those of the largest
doc_id holding it. The other lines stay, in their order, joined by ``\\n``.

Plan. Long enough lines are exploded, hashed and written (hashes, ids and positions, no text). A first, map-side
combined aggregate counts lines per key; keys with fewer lines than ``min_docs`` can't qualify, and most keys are
such. Only the rest's lines are gone on with, and distinct documents are counted on
them. A key that holds more lines than twice a partition's share (at most half as many keys as
partitions) meets its lines by a broadcast of those keys, all others by a shuffle. Positions to
drop are gathered per document, of which none has more than its lines, and the texts are put
together again by position.

Defined results: a null or empty text is one empty line; its document stays, with an empty text.
Rows that repeat a doc_id are one document in the count, and each loses its own lines. A null
doc_id is no document: such a row is never counted, never the one that keeps a line, and loses
shared lines like any other. Lines of a kept document that repeat within it stay. An empty table
gives no rows; columns of other names than doc_id and text are passed on (but for n_lines and
n_dropped, which are made anew).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import char_slices, cut, give_back, table
from commune.operators.skew import hot_threshold, lookup
from commune.session import shuffle_partitions

MIN_CHARS, MIN_DOCS = 40, 5
#: What is stripped from a line's ends: space and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines from which a key's rows are dealt to several tasks; it changes no result.
HOT_FLOOR = 10_000
#: Characters of the texts that are put together at a time.
SLICE = 4_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _UPPER.lower())


def _row_id(doc_id: Column, text: Column) -> Column:
    """Tells rows that repeat a doc_id apart by their text; equal rows lose equal lines."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def long_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_id, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    lines = documents.select("doc_id", _row_id(F.col("doc_id"), F.col("text")).alias("row_id"),
                             F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row_id", "pos", key_of(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        "doc_id", "row_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _with_hot(keys: DataFrame, partitions: int) -> DataFrame:
    total = keys.agg(F.sum("lines")).first()[0] or 0
    return keys.withColumn("hot", F.col("lines") > hot_threshold(total, partitions, HOT_FLOOR))


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_id, drop): the positions that a document's row loses, ascending."""
    partitions = shuffle_partitions(documents.sparkSession)
    # Three readers: written once (32 bytes a line before packing, no text), not cut and hashed thrice.
    lines = cut(long_lines(documents, min_chars))
    often = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= min_docs))
    often = _with_hot(often.withColumnRenamed("h2", "key_h2"), partitions)
    shared = cut(lookup(lines, often, "h1").where(F.col("h2") == F.col("key_h2")).drop("key_h2", "lines"))
    # Distinct documents of a key: one row per key and document first, so no key is one task's.
    held = shared.where("doc_id is not null").groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("lines"))
    keys = (held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"),
                                         F.sum("lines").alias("lines"))
            .where(F.col("docs") >= min_docs).select("h1", F.col("h2").alias("key_h2"), "last", "lines"))
    keys = _with_hot(cut(keys), partitions).drop("lines")
    lost = lookup(shared, keys, "h1").where(
        (F.col("h2") == F.col("key_h2")) & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last"))))
    return lost.groupBy("doc_id", "row_id").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def _without(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the positions ``drop``."""
    @F.pandas_udf("string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, drops in batches:
            start = 0
            for part in char_slices(texts, SLICE):
                out = []
                for t, d in zip(part, drops.iloc[start:start + len(part)]):
                    gone = set(d.tolist())
                    out.append("\n".join([x for k, x in enumerate(t.split("\n")) if k not in gone]))
                start += len(part)
                yield pd.Series(out, dtype=object)
        give_back()

    return kept(text, drop)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``documents`` with the kept ``text``, and ``n_lines`` (before) and ``n_dropped`` of each row."""
    lost = dropped_lines(documents, min_chars, min_docs).select(
        F.col("doc_id").alias("__doc_id"), F.col("row_id").alias("__lost_row"), F.col("drop").alias("__drop"))
    rows = documents.withColumn("__row_id", _row_id(F.col("doc_id"), F.col("text")))
    joined = rows.join(lost, rows["doc_id"].eqNullSafe(lost["__doc_id"]) & (F.col("__row_id") == F.col("__lost_row")),
                       "left")
    text = F.coalesce("text", F.lit(""))
    # Spark evaluates a Python column for all rows: those that lose nothing pass an empty text.
    cleaned = _without(F.when(F.col("__drop").isNotNull(), text).otherwise(F.lit("")),
                       F.coalesce("__drop", F.array().cast("array<int>")))
    out = {"text": F.when(F.col("__drop").isNotNull(), cleaned).otherwise(text)}
    return joined.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns if c not in
                           ("n_lines", "n_dropped")],
                         F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone
  FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""Helpers shared by the operators: tables, lineage cuts, held-out fold, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.session import ensure_checkpoint_dir
from commune.sources.tables import table

__all__ = ["table", "cut", "scratch_path", "text_or_empty", "held_out", "bounded_sample", "labelled_sample",
           "char_slices", "give_back"]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: the plan above starts from files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text divisible by five (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of ``key``: a top-k, never a full sort."""
    return df.orderBy(F.xxhash64(key.cast("string"), F.lit("sample")), key).limit(limit)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: Column,
                    limits: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of a bounded training sample, and all training rows per label.

    ``limits`` bounds the labelled ids of each label value; the ids are chosen from the
    labels alone (held-out ids and null labels are left out, repeated ids count once), so
    their broadcast is bounded by ``limits`` and the documents are scanned, not shuffled.
    """
    known = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
             .select("doc_id", label.cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect() if r.label in limits}
    picked = None
    for value, limit in limits.items():
        part = bounded_sample(known.where(F.col("label") == value), F.col("doc_id"), limit)
        picked = part if picked is None else picked.unionByName(part)
    rows = documents.select("doc_id", text_or_empty("text").alias("text"))
    return rows.join(F.broadcast(picked), "doc_id"), counts


def char_slices(texts, chars: int) -> Iterator:
    """Runs of rows of a batch of about ``chars`` characters: what is made of one is held at a time."""
    sizes = texts.str.len().to_numpy()
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > chars:
            yield texts.iloc[start:k]
            start, held = k, 0
        held += int(n) + 1
    if start < len(texts):
        yield texts.iloc[start:]


def give_back() -> None:
    """Return freed memory to the system: worker processes live on after a task and its batches."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass

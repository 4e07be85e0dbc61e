"""File-stream edge source: ``readStream.text`` with the batch scan rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commune.sources.edges import parse_edge_lines


def edge_stream(spark: SparkSession, path: str, delimiter: str = ",", ip_ids: bool = False,
                mode: str = "quarantine", max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Streaming ``(edges, rejects)`` over text files arriving in ``path``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    result = parse_edge_lines(reader.load(path), delimiter, ip_ids, mode)
    return result.edges, result.rejects

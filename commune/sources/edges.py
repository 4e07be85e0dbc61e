"""Edge-list text scan.

One edge per line: ``src<delim>dst[<delim>weight]``. The delimiter is a regular
expression. As with a Java ``String.split``, trailing empty tokens are dropped, every
token is trimmed of characters up to U+0020, two tokens give weight 1 and three give an
integer weight. Any other token count, or a token that is not a 64-bit integer (or, with
``ip_ids``, not a dotted quad), is malformed: ``mode="fail"`` raises with the line text,
``mode="quarantine"`` keeps the good rows and returns the bad ones with a reason.

Everything is a column expression over ``spark.read.text`` without lambdas, so parsing runs in
generated code. Each step (split, trimmed tokens, values) is used more than once by the next,
which keeps the optimizer from inlining it. The parsed row leaves through a one-element
generator: it is evaluated once per line whichever columns are read, so no projection, count or
aggregate above can skip the check of a line.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.functions.ip import ip_to_long_unchecked, long_to_ip

EDGE_SCHEMA = "src BIGINT, dst BIGINT, weight BIGINT"

# The reject reasons.
REASON_TOKENS = "token_count"
REASON_INTEGER = "bad_integer"
REASON_ADDRESS = "bad_address"

_INTEGER = r"^[+-]?[0-9]+$"
_BLANK = "".join(map(chr, range(33)))


@dataclass
class ScanResult:
    edges: DataFrame
    rejects: DataFrame | None


def _integer(tok: Column) -> Column:
    """The token as BIGINT; null if it is none, or out of range."""
    return F.when(tok.rlike(_INTEGER), tok.try_cast("bigint"))


def _values(lines: DataFrame, delimiter: str, ip_ids: bool, line_col: str, origin: Sequence[str] = ()) -> DataFrame:
    """(line, tokens, src, dst, weight, *origin): values are null where a token is malformed."""
    # Java drops trailing empty tokens: strip a trailing run of delimiter matches first.
    line = F.col(line_col)
    parts = lines.select(line.alias("line"), *origin, F.split(F.regexp_replace(line, f"(?:{delimiter})+$", ""), delimiter, -1)
                         .alias("parts"))
    toks = parts.select("line", *origin, F.coalesce(F.size("parts"), F.lit(0)).alias("tokens"),
                        *[F.btrim(F.get("parts", F.lit(i)), F.lit(_BLANK)).alias(f"t{i}") for i in range(3)])
    vertex = ip_to_long_unchecked if ip_ids else _integer
    weight = F.when(F.col("tokens") == 3, _integer(F.col("t2"))).otherwise(F.lit(1).cast("bigint"))
    return toks.select("line", *origin, "tokens", vertex(F.col("t0")).alias("src"), vertex(F.col("t1")).alias("dst"),
                       weight.alias("weight"))


def _reason(ip_ids: bool) -> Column:
    return (F.when(~F.col("tokens").between(2, 3), F.lit(REASON_TOKENS))
            .when(F.col("src").isNull() | F.col("dst").isNull(),
                  F.lit(REASON_ADDRESS if ip_ids else REASON_INTEGER))
            .when(F.col("weight").isNull(), F.lit(REASON_INTEGER)))


def classify(lines: DataFrame, delimiter: str = ",", ip_ids: bool = False, line_col: str = "value",
             origin: Sequence[str] = ()) -> DataFrame:
    """Per line: parsed (src, dst, weight) and a reject reason (null when the line is good)."""
    rows = _values(lines, delimiter, ip_ids, line_col, origin)
    row = F.struct("line", *origin, "src", "dst", "weight", _reason(ip_ids).alias("reason"))
    return rows.select(F.explode(F.array(row)).alias("r")).select("r.*")


def parse_edge_lines(lines: DataFrame, delimiter: str = ",", ip_ids: bool = False, mode: str = "fail",
                     line_col: str = "value", origin: Sequence[str] = ()) -> ScanResult:
    """Parse a DataFrame of text lines into ``edges(src, dst, weight)``.

    ``origin`` names columns of ``lines`` that tell where a line stands: rejects keep them, and
    an error names them.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "fail":
        rows = _values(lines, delimiter, ip_ids, line_col, origin).withColumn("reason", _reason(ip_ids))
        edge = F.struct("src", "dst", "weight")
        message = F.concat(F.lit("cannot read edge ("), F.col("reason"), F.lit("): "),
                           F.coalesce("line", F.lit("null")),
                           *[F.concat(F.lit(f" [{c} "), F.coalesce(F.col(c).cast("string"), F.lit("?")), F.lit("]"))
                             for c in origin])
        checked = F.when(F.col("reason").isNull(), edge).otherwise(
            F.raise_error(message).cast("struct<src:bigint,dst:bigint,weight:bigint>"))
        return ScanResult(rows.select(F.explode(F.array(checked)).alias("e")).select("e.*"), None)
    rows = classify(lines, delimiter, ip_ids, line_col, origin)
    good = rows.where(F.col("reason").isNull()).select("src", "dst", "weight")
    bad = rows.where(F.col("reason").isNotNull()).select("line", "reason", *origin)
    return ScanResult(good, bad)


def read_edges(spark: SparkSession, path: str, delimiter: str = ",", ip_ids: bool = False, mode: str = "fail",
               parallelism: int = -1) -> ScanResult:
    """Scan an edge-list text file or folder. ``parallelism`` > 0 repartitions the edges.

    Rejects have the ``file`` they stand in and the start of its ``block`` (the byte range that one
    task scanned); an error names them too.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"))
    result = parse_edge_lines(lines, delimiter, ip_ids, mode, origin=("file", "block"))
    if parallelism is not None and parallelism > 0:
        result = ScanResult(result.edges.repartition(parallelism), result.rejects)
    return result


def edges_to_lines(edges: DataFrame, delimiter: str = ",", with_weight: bool = True, ip_ids: bool = False) -> DataFrame:
    """Render ``edges`` as text lines (``value``): the inverse of the scan."""
    def fmt(c: str) -> Column:
        return long_to_ip(F.col(c)) if ip_ids else F.col(c).cast("string")

    cols = [fmt("src"), fmt("dst")] + ([F.col("weight").cast("string")] if with_weight else [])
    return edges.select(F.concat_ws(delimiter, *cols).alias("value"))

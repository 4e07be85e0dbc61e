"""Graphs derived from the star-schema test tables.

Each builder is a DataFrame job over whole tables; the result is an edge list
``(src, dst, weight)`` of BIGINTs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: supplier ids are shifted by this amount in the part-supplier graph so the
# two sides of the bipartite graph never share an id.
SUPPLIER_OFFSET = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation -> supplier nation, weight = number of line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, F.col("o_custkey") == c.c_custkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey))
    return j.groupBy(F.col("c_nationkey").cast("bigint").alias("src"),
                     F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite part -> supplier graph, weight = number of line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_partkey").cast("bigint").alias("src"),
        (F.col("l_suppkey") + F.lit(SUPPLIER_OFFSET)).cast("bigint").alias("dst"),
    ).agg(F.count(F.lit(1)).alias("weight"))


def part_supp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``part_supp`` one by one, an edge of weight 1 per line item: a level sums parallel edges itself."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").cast("bigint").alias("src"),
                     (F.col("l_suppkey") + F.lit(SUPPLIER_OFFSET)).cast("bigint").alias("dst"),
                     F.lit(1).cast("bigint").alias("weight"))


def _copart(spark: SparkSession, sf_dir: str, adjacent: bool) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = li.alias("a")
    b = li.alias("b")
    cond = F.col("a.l_orderkey") == F.col("b.l_orderkey")
    if adjacent:
        cond = cond & ((F.col("a.l_linenumber") + 1) == F.col("b.l_linenumber"))
    else:
        cond = cond & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))
    return a.join(b, cond).select(
        F.col("a.l_partkey").cast("bigint").alias("src"),
        F.col("b.l_partkey").cast("bigint").alias("dst"),
        F.lit(1).cast("bigint").alias("weight"),
    )


def copart_adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on consecutive lines of one order (parallel edges and self-loops kept)."""
    return _copart(spark, sf_dir, adjacent=True)


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on any two lines (earlier, later) of one order."""
    return _copart(spark, sf_dir, adjacent=False)


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed labelling of part vertices: community = the number in ``p_brand``."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("bigint").alias("id"),
        F.regexp_extract("p_brand", r"([0-9]+)$", 1).cast("bigint").alias("community"),
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed labelling of nation vertices: community = the nation's region."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"),
                    F.col("n_regionkey").cast("bigint").alias("community"))

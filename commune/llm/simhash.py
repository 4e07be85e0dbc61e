"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact Hamming links, components.

Fingerprint. The text's A-Z are lower-cased, words are runs of bytes other than space and
0x09-0x0D, shingles are ``words`` consecutive words joined by spaces (a shorter text is one
shingle). A bit of the 64-bit fingerprint is set if it is set in more than half of the
shingles' XXH64 (seed 42). A text without a word has fingerprint zero.

Links at ``max_bits`` = 2 or fewer differing bits. The 64 bits are a ring of three segments.
The pigeonring principle: if at most 2 bits differ, some segment starts a chain whose
cumulative differences stay within the proportional budgets 2/3, 4/3 and 2, that is 0 bits in
the first segment, at most 1 in the first two, at most 2 in all. A candidate pair therefore
agrees in a segment and differs in at most one bit of the next one: one side is keyed by the
two segments, the other by the two segments and each single-bit change of the second. The
join is an equality on about 43 bits; the full Hamming check follows. A pair is kept at its
first valid chain start only, so no pair is emitted twice.

Crowded keys. A key held by more than ``crowd`` distinct fingerprints would pair all of them.
Every fingerprint that touches such a key leaves the join on that key and is linked another
exact way: two fingerprints differ in at most 2 bits if and only if they share a point among
their 65 fingerprints at distance at most 1. At most 65 fingerprints share a point, so this
is linear in the fingerprints, and links are never lost.

Only distinct fingerprints are compared; copies never meet in pairs. Components are those of
the links; ``component_id`` is the smallest doc_id reachable (null ids don't count; null if
there is no other). Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows stay, each with its component. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import cut, table, text_or_empty
from commune.llm.components import connected_components

#: (offset, bits) of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of one candidate key above which the exact linear way takes over.
CROWD = 32
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint, unsigned."""
    toks = text.encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    line, digest = b" ".join(toks), xxhash.xxh64_intdigest
    if len(toks) <= words:
        return digest(line, SEED)
    ends = list(accumulate(len(t) + 1 for t in toks))
    starts = [0, *ends[:len(toks) - words]]
    h = np.array([digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[words - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """The fingerprint as a BIGINT (two's complement)."""
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).astype(np.int64))

    return simhash(text_or_empty(text))


def _segment(col: str, k: int) -> Column:
    offset, bits = SEGMENTS[k]
    return F.shiftrightunsigned(F.col(col), offset).bitwiseAND(F.lit((1 << bits) - 1))


def _key(col: str, i: int, flip: int = 0) -> Column:
    """Ring position, segment i and segment i+1 (with ``flip`` applied) packed into a BIGINT."""
    j = (i + 1) % 3
    first, second = _segment(col, i), _segment(col, j)
    if flip:
        second = second.bitwiseXOR(F.lit(flip))
    return (F.lit(i << 44) + F.shiftleft(first, 22) + second).cast("bigint")


def _index_keys(col: str) -> Column:
    return F.array(*[_key(col, i) for i in range(3)])


def _probe_keys(col: str) -> Column:
    return F.array(*[_key(col, i, flip) for i in range(3)
                     for flip in [0, *(1 << b for b in range(SEGMENTS[(i + 1) % 3][1]))]])


def _chain_from(i: int) -> Column:
    """Whether the differences of ``a`` and ``b`` fit the budgets in a chain starting at segment i."""
    diff = [F.bit_count(_segment("a", k % 3).bitwiseXOR(_segment("b", k % 3))) for k in (i, i + 1)]
    return (diff[0] == 0) & (diff[1] <= 1)


def near_pairs(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all links between distinct ``fps(fp)``."""
    fps = fps.select("fp")
    index = fps.select(F.col("fp").alias("a"), F.explode(_index_keys("fp")).alias("key"))
    probe = fps.select(F.col("fp").alias("b"), F.explode(_probe_keys("fp")).alias("key"))
    crowded = cut(index.groupBy("key").count().where(F.col("count") > crowd).select("key"))
    hot = not crowded.isEmpty()
    index_rest = index.join(crowded, "key", "left_anti") if hot else index
    ring = F.shiftrightunsigned(F.col("key"), 44)
    first = (F.when(_chain_from(0), 0).when(_chain_from(1), 1).when(_chain_from(2), 2))
    pairs = (index_rest.join(probe, "key")
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
             .where(first == ring).select("a", "b"))
    # The mirrored pair (b indexed, a probing) meets the same chain, so a < b loses nothing; a
    # pair whose first chain start is a crowded key touches that key from both ends (below).
    if not hot:
        return pairs
    touching = (index.withColumnRenamed("a", "fp").unionByName(probe.withColumnRenamed("b", "fp"))
                .join(crowded, "key", "left_semi").select("fp").distinct())
    points = touching.select("fp", F.explode(F.array(
        F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("point"))
    shared = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    stars = shared.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(documents: DataFrame, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``documents``."""
    docs = cut(documents.select("doc_id", fingerprint_column(F.col("text"), words).alias("fp")))
    groups = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = connected_components(near_pairs(groups, crowd))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per fingerprint that has another row or a link; all others are their own component.
    known = (linked.select("fp", "root").join(least, "root").select("fp", "component_id")
             .unionByName(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left_anti")
                          .where("copies > 1").select("fp", F.col("least").alias("component_id"))))
    return (docs.join(known.withColumn("known", F.lit(True)), "fp", "left")
            .select("doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
                    .alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, all its columns unchanged.

    A row without an id can't be named by a decision and stays. Rows that repeat an id are one
    document: it stays if it represents any group, as the row with the smallest text.
    """
    found = components(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    stays = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(dropped.join(stays, "doc_id", "left_anti"), "doc_id", "left_anti").select(*docs.columns)
    return _first_of_repeated(kept, repeated)


def _first_of_repeated(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for each id of ``repeated``, by a partially aggregated minimum."""
    single = docs.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(F.col("text"), *[F.col(c) for c in docs.columns if c != "text"])
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return single.unionByName(least.select("row.*").select(*docs.columns))

"""Registered queries: one builder per operator of the inventory, ``(spark, sf_dir) -> DataFrame``.

Each reads the star-schema tables, derives a graph from them with Spark and runs the
library operator over the whole graph. Column names match the plain-SQL statements in
``oracle_sql``.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.functions.ip import ip_to_long, long_to_ip
from commune.functions.score import ceil_score, reported_score
from commune.functions.text import state_text
from commune.operators import moves
from commune.operators.compress import compress_edges, compress_vertices
from commune.operators.graph import (Level, build_level, initial_stats, materialize, merge_edges,
                                     singleton_assignment, symmetrize, triplets, vertices_from_edges,
                                     weighted_degree)
from commune.plans.detect import detect, half_pass, level_state, local_moving, observe, prepare_edges
from commune.operators.skew import lookup
from commune.session import ensure_checkpoint_dir, shuffle_partitions
from commune.sources import tables
from commune.sources.edges import edges_to_lines, parse_edge_lines, read_edges
from commune.sources.sinks import community_rows

Builder = Callable[[SparkSession, str], DataFrame]

# The multipliers spreading table keys over the address space.
IP_KEY_MULT_ORDERS = 2654435761
IP_KEY_MULT_CUSTOMER = 40503


def round9(c):
    """Round a summed score to 9 decimals the same way the SQL statements do."""
    return F.round(c * F.lit(1e9)).cast("bigint") / F.lit(1e9)


def _level(spark: SparkSession, edges: DataFrame) -> Level:
    ensure_checkpoint_dir(spark)
    return build_level(prepare_edges(edges), shuffle_partitions(spark))


def _brand_setup(spark: SparkSession, sf_dir: str):
    """copart_adj labelled by brand: level, labels, incident (flagged) and statistics."""
    lv = _level(spark, tables.copart_adj(spark, sf_dir))
    labels = tables.brand_labels(spark, sf_dir).join(lv.vert.select("id"), "id")
    assign = labels.select("id", "community", F.lit(False).alias("changed"))
    flagged, stats = observe(lv, assign)
    return lv, assign, flagged, stats


# --- sources ---------------------------------------------------------------------------

def q_edge_scan(spark, sf_dir):
    e = tables.part_supp(spark, sf_dir)
    lines = e.select(F.concat(F.lit(" "), F.col("src").cast("string"), F.lit(" , "), F.col("dst").cast("string"),
                              F.lit(","), F.col("weight").cast("string"), F.lit(",")).alias("value"))
    return parse_edge_lines(lines, ",").edges


def q_edge_scan_default_weight(spark, sf_dir):
    lines = edges_to_lines(tables.copart_adj(spark, sf_dir), " ", with_weight=False)
    return parse_edge_lines(lines, " ").edges


def _reject_lines(spark, sf_dir):
    t = lambda n: tables.table(spark, sf_dir, n)
    s = F.col
    good = edges_to_lines(tables.part_supp(spark, sf_dir), ",")
    bad = [
        t("nation").select(F.concat_ws(",", s("n_name"), s("n_regionkey").cast("string")).alias("value")),
        t("region").select(s("r_name").alias("value")),
        t("orders").select(F.concat_ws(",", s("o_orderkey").cast("string"), s("o_custkey").cast("string"),
                                       s("o_orderpriority")).alias("value")),
        t("customer").select(F.concat_ws(",", s("c_custkey").cast("string"), s("c_nationkey").cast("string"),
                                         F.lit("1"), F.lit("2")).alias("value")),
        t("supplier").select(F.concat_ws(",", s("s_suppkey").cast("string"), F.lit(""),
                                         s("s_nationkey").cast("string")).alias("value")),
        # Digits beyond the 64-bit range, as id and as weight.
        t("part").select(F.concat(F.lit("99999999999999999999,"), s("p_partkey").cast("string")).alias("value")),
        t("part").select(F.concat(s("p_partkey").cast("string"), F.lit(",2,-99999999999999999999")).alias("value")),
    ]
    out = good
    for b in bad:
        out = out.unionAll(b)
    return out


def q_edge_scan_rejects(spark, sf_dir):
    return parse_edge_lines(_reject_lines(spark, sf_dir), ",", mode="quarantine").rejects


def q_edge_scan_files(spark, sf_dir):
    """Edge-list files written and scanned again, the edges dealt over a given number of partitions."""
    path = f"{ensure_checkpoint_dir(spark)}/edge-lists-{uuid.uuid4().hex}"
    edges_to_lines(tables.part_supp(spark, sf_dir), "\t").write.text(path)
    return read_edges(spark, path, "\t", parallelism=6).edges


def q_edge_scan_ip(spark, sf_dir):
    lines = edges_to_lines(tables.part_supp(spark, sf_dir), ",", ip_ids=True)
    return parse_edge_lines(lines, ",", ip_ids=True).edges


def q_ip_to_long(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    key = F.pmod(F.col("o_orderkey") * F.lit(IP_KEY_MULT_ORDERS) + F.col("o_custkey"), F.lit(4294967296))
    ips = o.select(F.col("o_orderkey").alias("key"), long_to_ip(key).alias("ip"))
    return ips.select("key", "ip", ip_to_long(F.col("ip")).alias("value"))


def q_long_to_ip(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    x = F.col("c_custkey") * F.lit(IP_KEY_MULT_CUSTOMER) + F.col("c_nationkey")
    return c.select(F.col("c_custkey").alias("key"), x.alias("address"), long_to_ip(x).alias("value"))


# --- graph building --------------------------------------------------------------------

def q_vertices_from_edges(spark, sf_dir):
    return vertices_from_edges(tables.copart_adj(spark, sf_dir))


def q_graph_counts(spark, sf_dir):
    e = tables.copart_adj(spark, sf_dir)
    # One evaluation of the edges: per ordered pair first, then both ends of each pair.
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    ends = pairs.select(F.col("k"), (F.col("src") == F.col("dst")).alias("loop"),
                        F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("first")),
                                          F.struct(F.col("dst").alias("id"), F.lit(0).alias("first")))).alias("e"))
    first = F.col("e.first") == 1
    per_vertex = ends.groupBy("e.id").agg(
        F.sum(F.when(first, F.col("k")).otherwise(0)).alias("edges"), F.count_if(first).alias("distinct_edges"),
        F.sum(F.when(first & F.col("loop"), F.col("k")).otherwise(0)).alias("self_loops"))
    return per_vertex.agg(F.count(F.lit(1)).alias("vertices"), F.sum("edges").alias("edges"),
                          F.sum("distinct_edges").alias("distinct_edges"), F.sum("self_loops").alias("self_loops"))


def q_weighted_degree(spark, sf_dir):
    return weighted_degree(tables.copart_adj(spark, sf_dir))


def q_merge_edges(spark, sf_dir):
    return merge_edges(tables.copart_adj(spark, sf_dir))


def q_symmetrize(spark, sf_dir):
    return symmetrize(merge_edges(tables.copart_adj(spark, sf_dir)))


def q_init_state(spark, sf_dir):
    lv = _level(spark, tables.part_supp_items(spark, sf_dir))
    st = initial_stats(lv)
    return lv.vert.join(st, F.col("id") == F.col("community")).select(
        "id", "community", "out_w", "int_n", "int_w", "n", "t", "a", F.lit(False).alias("changed"))


def q_triplets(spark, sf_dir):
    e = merge_edges(tables.nation_trade(spark, sf_dir))
    return triplets(e, tables.region_labels(spark, sf_dir))


# --- one half-pass on a fixed labelling ------------------------------------------------

def q_incident(spark, sf_dir):
    _, _, flagged, _ = _brand_setup(spark, sf_dir)
    return flagged.select("id", F.col("c").alias("community"), "inc_w")


def q_community_stats(spark, sf_dir):
    _, _, _, stats = _brand_setup(spark, sf_dir)
    return stats.select("community", "n", "a", "t")


def q_state_with_stats(spark, sf_dir):
    _, assign, _, stats = _brand_setup(spark, sf_dir)
    return lookup(assign, stats, "community").select("id", "community", "n", "a", "t")


def q_community_score(spark, sf_dir):
    lv, _, _, stats = _brand_setup(spark, sf_dir)
    N = lv.total_vertices
    return stats.select("community", ceil_score(F.col("n"), F.col("a"), F.col("t"), N).alias("score"))


def q_reported_score(spark, sf_dir):
    lv, _, _, stats = _brand_setup(spark, sf_dir)
    N = lv.total_vertices
    return stats.select("community", reported_score(F.col("n"), F.col("a"), F.col("t"), N).alias("reported_score"))


def q_join_gain(spark, sf_dir):
    lv, _, flagged, stats = _brand_setup(spark, sf_dir)
    return moves.with_gains(lv, flagged, stats, broadcast_stats=False).where("NOT own").select(
        "id", F.col("c").alias("community"), "gain")


def _brand_decision(spark, sf_dir):
    lv, assign, _, _ = _brand_setup(spark, sf_dir)
    assign = materialize(assign)
    stats = materialize(moves.statistics(lv, assign))
    vertices = moves.vertex_table(lv, assign)
    parts = [p.persist(StorageLevel.MEMORY_AND_DISK)
             for p in moves.flagged_parts(lv, vertices, moves.incident_parts(lv, assign, stats))]
    return moves.decide(lv, vertices, parts, stats, down=True, broadcast_stats=False, detail=True)[0]


def q_stay_gain(spark, sf_dir):
    return _brand_decision(spark, sf_dir).select("id", F.col("prev").alias("community"),
                                                 F.col("stay").alias("gain"))


def q_best_move(spark, sf_dir):
    return _brand_decision(spark, sf_dir).select("id", F.col("prev").alias("community"), "best_community")


def q_compress_vertices(spark, sf_dir):
    _, _, _, stats = _brand_setup(spark, sf_dir)
    return compress_vertices(stats)


def q_compress_edges(spark, sf_dir):
    lv, assign, flagged, _ = _brand_setup(spark, sf_dir)
    return compress_edges(lv, assign, flagged)


# --- iterative results on part_supp -----------------------------------------------------

def _half_passes(spark, sf_dir, k):
    lv = _level(spark, tables.part_supp_items(spark, sf_dir))
    assign = singleton_assignment(lv)
    stats = moves.with_hot(lv, initial_stats(lv))
    for i in range(k):
        new, cached = half_pass(spark, lv, assign, stats if i == 0 else None, down=(i % 2 == 0),
                                communities_bound=lv.vertices)
        assign = materialize(new)
        for df in cached:
            df.unpersist()
    return assign


def q_half_pass_1(spark, sf_dir):
    return _half_passes(spark, sf_dir, 1).select("id", "community", "changed")


def q_half_pass_2(spark, sf_dir):
    return _half_passes(spark, sf_dir, 2).select("id", "community", "changed")


def _level0(spark, sf_dir, min_progress=2000, progress_counter=1):
    lv = _level(spark, tables.part_supp_items(spark, sf_dir))
    out = local_moving(spark, lv, 0, min_progress, progress_counter, moves.with_hot(lv, initial_stats(lv)))
    return lv, out


def q_changed_count(spark, sf_dir):
    _, out = _level0(spark, sf_dir)
    rows = [(i + 1, m) for i, m in enumerate(out.movers)]
    return spark.createDataFrame(rows, "half_pass INT, moved BIGINT")


def q_local_moving(spark, sf_dir):
    _, out = _level0(spark, sf_dir)
    return out.assign.select("id", "community")


def q_level_scores(spark, sf_dir):
    r = detect(spark, tables.part_supp_items(spark, sf_dir), min_progress=2000, progress_counter=1, max_levels=1)
    return r.levels.select("level", round9(F.col("score")).alias("score"),
                           round9(F.col("reported_score")).alias("reported_score"), "passes", "communities")


def q_level_state(spark, sf_dir):
    lv, out = _level0(spark, sf_dir)
    return level_state(out)


def q_level_state_text(spark, sf_dir):
    lv, out = _level0(spark, sf_dir)
    st = level_state(out)
    return st.select("id", state_text(F.col("id"), F.col("community"), F.col("t"), F.col("int_w"), F.col("out_w"),
                                      F.col("int_n"), F.col("n"), F.col("a")).alias("line"))


def _multilevel(spark, sf_dir):
    return detect(spark, tables.part_supp_items(spark, sf_dir), min_progress=2000, progress_counter=2)


def q_multilevel(spark, sf_dir):
    r = _multilevel(spark, sf_dir)
    return r.state.select("level", "id", "community")


def q_level_hooks(spark, sf_dir):
    """What the hooks of a run are given: each level's state and membership, and the final state."""
    seen = []

    def hook(name, vertex, keep=lambda rows: rows):
        return lambda level, *rest: seen.append(keep(rest[-1].select(
            F.lit(name).alias("hook"), F.lit(level).alias("level"), F.col(vertex).alias("id"), "community")))

    # The table behind a level's membership is deleted when a later level's stands.
    detect(spark, tables.part_supp_items(spark, sf_dir), min_progress=2000, progress_counter=2, on_level=hook("level", "id"),
           on_membership=hook("membership", "vertex", materialize), on_final=hook("final", "id"))
    return reduce(DataFrame.unionByName, seen)


def q_membership(spark, sf_dir):
    return _multilevel(spark, sf_dir).membership


def q_community_members(spark, sf_dir):
    return community_rows(_multilevel(spark, sf_dir).membership)


CATALOG: dict[str, Builder] = {
    "edge_scan": q_edge_scan,
    "edge_scan_default_weight": q_edge_scan_default_weight,
    "edge_scan_rejects": q_edge_scan_rejects,
    "edge_scan_ip": q_edge_scan_ip,
    "edge_scan_files": q_edge_scan_files,
    "ip_to_long": q_ip_to_long,
    "long_to_ip": q_long_to_ip,
    "vertices_from_edges": q_vertices_from_edges,
    "graph_counts": q_graph_counts,
    "weighted_degree": q_weighted_degree,
    "merge_edges": q_merge_edges,
    "symmetrize": q_symmetrize,
    "init_state": q_init_state,
    "triplets": q_triplets,
    "incident": q_incident,
    "community_stats": q_community_stats,
    "state_with_stats": q_state_with_stats,
    "community_score": q_community_score,
    "reported_score": q_reported_score,
    "join_gain": q_join_gain,
    "stay_gain": q_stay_gain,
    "best_move": q_best_move,
    "compress_vertices": q_compress_vertices,
    "compress_edges": q_compress_edges,
    "half_pass_1": q_half_pass_1,
    "half_pass_2": q_half_pass_2,
    "changed_count": q_changed_count,
    "local_moving": q_local_moving,
    "level_scores": q_level_scores,
    "level_state": q_level_state,
    "level_state_text": q_level_state_text,
    "multilevel": q_multilevel,
    "level_hooks": q_level_hooks,
    "membership": q_membership,
    "community_members": q_community_members,
}

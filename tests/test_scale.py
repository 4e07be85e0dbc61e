"""Plan and life-cycle properties that matter at scale."""

import os

import pytest
from pyspark.sql import functions as F

from commune.operators import moves
from commune.operators.compress import compress_edges
from commune.operators.graph import build_level, initial_stats, level_partitions, materialize, singleton_assignment
from commune.plans import detect as loops
from commune.plans.detect import detect, half_pass, local_moving, observe, prepare_edges
from commune.plans.job import run_job
from commune.session import ensure_checkpoint_dir
from commune.sources import tables
from commune.sources.edges import parse_edge_lines, read_edges
from tests.conftest import SF001, edges_df


def plan_lines(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def exchanges_over_cached_sym(lines):
    """Exchanges that stand directly above the cached ``sym`` layout."""
    found = []
    for k, line in enumerate(lines):
        if "InMemoryTableScan" in line and "nbr" in line:
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            for above in reversed(lines[:k]):
                if len(above) - len(above.lstrip(" :+-*()0123456789")) < depth:
                    if "Exchange" in above:
                        found.append(above)
                    if any(x in above for x in ("Join", "Exchange", "Aggregate")):
                        break
    return found


@pytest.mark.parametrize("hot_floor", [50_000, 1])
def test_message_join_does_not_shuffle_sym(spark, hot_floor):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    level = build_level(prepare_edges(tables.part_supp(spark, SF001)), 64, hot_floor=hot_floor)
    assert level.salted == (hot_floor == 1)
    assign = materialize(singleton_assignment(level))
    lines = plan_lines(moves.incident(level, assign))
    assert any("InMemoryTableScan" in x for x in lines)
    assert exchanges_over_cached_sym(lines) == []
    level.release()


def files_below(folder):
    return sum(len(files) for _, _, files in os.walk(folder.removeprefix("file:")))


def test_detect_deletes_superseded_checkpoints(spark):
    folder = ensure_checkpoint_dir(spark)
    before = files_below(folder)
    r = detect(spark, edges_df(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]),
               2000, 2, partitions=4)
    rows = r.membership.count()
    # Left are four tables of each level that the result reads: every half-pass's is gone.
    kept = files_below(folder) - before
    assert kept <= 4 * len(r.outcomes) * 2 * (spark.sparkContext.defaultParallelism + 8) + 8
    assert sum(len(o.movers) for o in r.outcomes) > 4
    assert r.membership.count() == rows and r.state.count() > 0
    r.release()
    assert files_below(folder) <= before + 8


def test_fail_mode_checks_every_line_whatever_is_read(spark):
    lines = spark.createDataFrame([(x,) for x in ("1,2", "bad", "3,x")], "value STRING")
    edges = parse_edge_lines(lines, ",").edges
    for read in (lambda: edges.select("dst").collect(), lambda: edges.select("dst", "weight").collect(),
                 lambda: edges.count(), lambda: edges.groupBy("dst").agg(F.sum("weight")).collect(),
                 lambda: edges.select(F.lit(1)).collect(), lambda: edges.where("weight > 0").collect()):
        with pytest.raises(Exception, match="cannot read edge"):
            read()


def test_overflow_is_a_bad_integer(spark):
    big = "99999999999999999999"
    lines = spark.createDataFrame([(x,) for x in ("1,2", f"{big},2", f"1,2,{big}")], "value STRING")
    r = parse_edge_lines(lines, ",", mode="quarantine")
    assert [tuple(x) for x in r.edges.collect()] == [(1, 2, 1)]
    assert {x.reason for x in r.rejects.collect()} == {"bad_integer"} and r.rejects.count() == 2


def test_read_edges_repartitions(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1,2\n2,3,4\n")
    scan = read_edges(spark, str(tmp_path / "e.txt"), parallelism=5)
    assert scan.edges.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, scan.edges.collect())) == [(1, 2, 1), (2, 3, 4)]


def test_hooks_and_empty_graph(spark):
    seen = []
    hooks = dict(on_level=lambda n, s, d: seen.append(("level", n, s, d.count())),
                 on_final=lambda n, s, d: seen.append(("final", n, s, d.count())),
                 on_membership=lambda n, d: seen.append(("members", n, d.count())))
    r = detect(spark, edges_df(spark, [(1, 2, 1), (2, 3, 1)]), 2000, 1, **hooks)
    assert [x[0] for x in seen] == ["level", "members"] * len(r.outcomes) + ["final"]
    seen.clear()
    r = detect(spark, edges_df(spark, []), 2000, 1, **hooks)
    assert seen == [("level", 0, 0.0, 0), ("members", 0, 0), ("final", 0, 0.0, 0)]
    assert [(x.level, x.score, x.reported_score) for x in r.levels.collect()] == [(0, 0.0, 0.0)]
    assert r.membership.count() == 0


def test_singleton_compression_keeps_vertices_and_merges_directions(spark):
    level = build_level(edges_df(spark, [(1, 2, 1), (2, 1, 3), (2, 2, 5), (2, 3, 1), (3, 4, 2), (3, 4, 2)]), 4)
    assign = materialize(singleton_assignment(level))
    flagged, stats = observe(level, assign)
    assert sorted(map(tuple, compress_edges(level, assign, flagged).collect())) == [(1, 2, 4), (2, 3, 1), (3, 4, 4)]
    assert stats.count() == 4


def test_guard_is_reported(spark):
    r = detect(spark, tables.copart_adj(spark, SF001), 1, 50, max_half_passes=2, max_levels=1)
    assert r.outcomes[0].half_passes == 2 and r.outcomes[0].guarded


def test_cluster_without_a_checkpoint_folder_raises():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_job_rerun_leaves_no_stale_levels(spark, tmp_path):
    src = tmp_path / "edges.txt"
    src.write_text("1 2\n2 3\n1 3\n4 5\n5 6\n4 6\n3 4\n")
    out = str(tmp_path / "out")
    run_job(spark, str(src), out, " ", 2000, 2, member_lists=True, max_per_part=2)
    assert os.path.isdir(f"{out}/level_1_vertices") and os.path.isdir(f"{out}/members/level=1")
    parts = spark.read.parquet(f"{out}/members/level=0").collect()
    assert sorted(v for p in parts for v in p.members) == [1, 2, 3, 4, 5, 6]
    assert {p.parts for p in parts} == {2}
    run_job(spark, str(src), out, " ", 2000, 1, member_lists=True, partitions=3)
    assert not os.path.isdir(f"{out}/level_1_vertices") and not os.path.isdir(f"{out}/membership/level=1")


def test_partitions_follow_the_rows():
    assert level_partitions(0, 200) == level_partitions(24, 200) == 1
    assert level_partitions(1_000_000, 200) == 10 and level_partitions(10 ** 9, 200) == 200
    assert level_partitions(1000, 64, hot_floor=1) == 64


@pytest.mark.parametrize("hot_floor,broadcast", [(50_000, True), (300, True), (300, False), (1, False)])
def test_half_pass_has_one_message_shuffle_and_no_sort(spark, hot_floor, broadcast):
    level = build_level(prepare_edges(tables.part_supp(spark, SF001)), 64, hot_floor=hot_floor)
    assert level.salted == (hot_floor == 1)
    assign = materialize(singleton_assignment(level))
    vertices = moves.vertex_table(level, assign)
    parts = moves.flagged_parts(level, vertices, moves.incident_parts(level, assign))
    stats = materialize(moves.with_hot(level, initial_stats(level)))
    new, cached = moves.decide(level, vertices, parts, stats, True, broadcast)
    new.count()
    text = new._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Sort [" not in text
    if broadcast and not level.salted:
        # Messages are dealt by the level's own layout and by no exchange of Spark's.
        assert "ENSURE_REQUIREMENTS" not in text.split("== Initial Plan ==")[0]
    for df in cached:
        df.unpersist()
    level.release()


RING = [e for i in range(6) for e in ((3 * i + 1, 3 * i + 2, 1), (3 * i + 2, 3 * i + 3, 1), (3 * i + 1, 3 * i + 3, 1),
                                       (3 * i + 3, (3 * i + 3) % 18 + 1, 1))]


@pytest.mark.parametrize("hot_floor", [20, 1])
def test_frontier_half_passes_equal_full_ones(spark, hot_floor, monkeypatch):
    # A star beside the ring: a hub at floor 1, and vertices that no mover is near.
    star = [(100, 101 + k, 1) for k in range(20)] + [(200, 201, 1), (201, 202, 1)]
    level = build_level(prepare_edges(edges_df(spark, RING + star)), 16, hot_floor=hot_floor)
    assert level.partitions > 1 and level.salted == (hot_floor == 1)
    first = moves.with_hot(level, initial_stats(level))
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", -1.0)
    full = local_moving(spark, level, 0, 2000, 2, first)
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", 1.0)
    monkeypatch.setattr(loops, "FRONTIER_ROWS", 1.0)
    some = local_moving(spark, level, 0, 2000, 2, first)
    assert full.movers == some.movers and full.score == some.score and full.reported_score == some.reported_score
    cols = ["id", "community", "changed", "prev", "n", "a", "t", "own_value", "best_gain", "best_c"]
    assert sorted(map(str, full.assign.select(cols).collect())) == sorted(map(str, some.assign.select(cols).collect()))
    assert set(full.message_rows) == {level.sym_rows}
    assert some.message_rows[:2] == [level.sym_rows] * 2 and min(some.message_rows) < level.sym_rows
    assert all(r == 0 for r, m in zip(some.message_rows[2:], some.movers[1:]) if m == 0)
    level.release()


def test_score_has_equal_bits_on_any_partitions(spark):
    level = build_level(prepare_edges(tables.copart_adj(spark, SF001)), 8)
    stats = materialize(observe(level, materialize(tables.brand_labels(spark, SF001).join(
        level.vert.select("id"), "id").select("id", "community", F.lit(False).alias("changed"))))[1])
    found = {moves.score_totals(level, stats.repartition(n)) for n in (1, 8, 200)}
    assert len(found) == 1
    score, reported = found.pop()
    terms = [2 * r.a * r.a / ((r.n - 1) * r.t * level.total_vertices) for r in stats.collect() if r.n > 1 and r.t]
    assert score == pytest.approx(sum(terms), rel=1e-14)
    level.release()


def test_one_job_per_half_pass_and_steady_memory(spark):
    rows = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]
    store = spark._jsparkSession.sharedState().statusStore()
    last = lambda: max([x.executionId() for x in jvm_list(store.executionsList())], default=-1)
    before, cached = last(), set(spark.sparkContext._jsc.getPersistentRDDs())
    r = detect(spark, edges_df(spark, rows), 2000, 1)
    assert r.outcomes[0].half_passes == 4
    assert last() - before <= 9
    r.release()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached


def jvm_list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_score_that_drives_compression(spark):
    edges = tables.copart_adj(spark, SF001)
    with pytest.raises(ValueError, match="unknown score"):
        detect(spark, edges, compress_by="best")
    r = detect(spark, edges, 2000, 2, compress_by="score", max_levels=2)
    assert len(r.outcomes) == 2 and r.levels.count() == 2


def test_rejects_and_errors_name_their_file(spark, tmp_path):
    (tmp_path / "good.txt").write_text("1,2\n")
    (tmp_path / "bad.txt").write_text("2,3\nx,1\n")
    scan = read_edges(spark, str(tmp_path), mode="quarantine")
    assert [(r.line, r.file.endswith("bad.txt"), r.block) for r in scan.rejects.collect()] == [("x,1", True, 0)]
    with pytest.raises(Exception, match="bad.txt"):
        read_edges(spark, str(tmp_path)).edges.collect()

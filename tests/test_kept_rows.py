"""Half-passes whose movers alone send messages: same rows as full ones, no shuffle of what is kept."""

import pytest

from commune.operators import moves
from commune.operators.compress import compress_edges
from commune.operators.graph import DEGREE_STEPS, build_level, initial_stats, materialize, singleton_assignment
from commune.plans import detect as loops
from commune.session import broadcast_ok
from commune.sources import tables
from tests.conftest import SF001, edges_df

# Weights that cancel out: a row of weight 0 stands as long as an edge is behind it.
ODD = [e for i in range(8) for e in ((3 * i + 1, 3 * i + 2, 2), (3 * i + 2, 3 * i + 3, 1), (3 * i + 1, 3 * i + 3, 1),
                                     (3 * i + 3, (3 * i + 3) % 24 + 1, -1), (3 * i + 3, (3 * i + 3) % 24 + 2, 1))] + [
    (1, 1, 3), (5, 5, 0), (7, 90, 0), (None, 4, 1), (4, None, 2)] + [(100, 101 + k, k % 3 - 1) for k in range(60)]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("graph,hot_floor", [("part_supp", 20), ("odd", 20), ("odd", 1)])
def test_kept_rows_give_what_full_messages_give(spark, graph, hot_floor, monkeypatch):
    edges = edges_df(spark, ODD) if graph == "odd" else tables.part_supp(spark, SF001)
    level = build_level(loops.prepare_edges(edges), 8, hot_floor=hot_floor)
    assert level.partitions > 1 and level.salted == (hot_floor == 1)
    first = moves.with_hot(level, initial_stats(level))
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", -1.0)
    monkeypatch.setattr(loops, "_few_communities", lambda *_: True)
    monkeypatch.setattr(loops, "KEPT_HALF_PASSES", 2)
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    found = []
    for share in (-1.0, 1.0):
        monkeypatch.setattr(loops, "KEPT_ROWS", share)
        found.append(loops.local_moving(spark, level, 0, 2000, 2, first))
    full, kept = found
    assert full.movers == kept.movers and (full.score, full.reported_score) == (kept.score, kept.reported_score)
    assert rows(full.assign) == rows(kept.assign) and rows(full.stats) == rows(kept.stats)
    n = len(full.movers)
    assert n > 4 and full.sent_rows == [level.sym_rows] * n and kept.message_rows == full.message_rows
    # All messages, then twice the movers' alone.
    assert [k for k, sent in enumerate(kept.sent_rows) if sent == level.sym_rows] == list(range(0, n, 3))
    level.release()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached


@pytest.mark.parametrize("hot_floor", [300, 1])
def test_moved_parts_equal_new_ones(spark, hot_floor):
    level = build_level(loops.prepare_edges(tables.part_supp(spark, SF001)), 48, hot_floor=hot_floor)
    assert level.salted == (hot_floor == 1)
    assign = materialize(singleton_assignment(level))
    stats = materialize(moves.with_hot(level, initial_stats(level)))
    new, cached, parts = loops._half_pass(spark, level, assign, stats, True, level.vertices)
    state = materialize(new)
    assert state.where("changed").count() > 0
    moved, anew = moves.moved_parts(level, state, parts), moves.incident_parts(level, state)
    assert [rows(x) for x in moved] == [rows(x) for x in anew]
    if not level.salted:
        flagged = moves.flagged_parts(level, moves.vertex_table(level, state), moved)[0]
        flagged.count()
        text = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Union" in text and "ENSURE_REQUIREMENTS" not in text
    for df in [*cached, *parts]:
        df.unpersist()
    level.release()


def test_statistics_of_a_million_communities_are_broadcast(spark):
    assert broadcast_ok(spark, 1 << 20, least_limit=loops.STATS_BYTES)
    assert not broadcast_ok(spark, 1 << 20) and not broadcast_ok(spark, (1 << 20) + 1, least_limit=loops.STATS_BYTES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not broadcast_ok(spark, 1, least_limit=loops.STATS_BYTES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("graph,hot_floor", [("part_supp", 20), ("odd", 20), ("no_loops", 1)])
def test_touched_statistics_alone_give_what_full_messages_give(spark, graph, hot_floor, monkeypatch):
    edges = {"part_supp": lambda: tables.part_supp(spark, SF001), "odd": lambda: edges_df(spark, ODD),
             "no_loops": lambda: edges_df(spark, [e for e in ODD if e[0] != e[1]])}[graph]()
    level = build_level(loops.prepare_edges(edges), 8, hot_floor=hot_floor)
    assert level.partitions > 1 and level.salted == (hot_floor == 1)
    assert level.counts.loops == {"part_supp": 0, "odd": 2, "no_loops": 0}[graph]
    first = moves.with_hot(level, initial_stats(level))
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", -1.0)
    # All communities are too many to broadcast at first, the touched ones aren't.
    real, patched = loops._patched_half_pass, []
    monkeypatch.setattr(loops, "_patched_half_pass", lambda *a: patched.append(a) or real(*a))
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    found = []
    for share, bound in ((-1.0, -1), (1.0, level.vertices // 4)):
        monkeypatch.setattr(loops, "KEPT_ROWS", share)
        monkeypatch.setattr(loops, "_few_communities", lambda _s, _l, n, bound=bound: n <= bound)
        found.append(loops.local_moving(spark, level, 0, 2000, 1, first))
    full, kept = found
    assert patched and full.movers == kept.movers
    assert (full.score, full.reported_score) == (kept.score, kept.reported_score)
    cols = ["id", "community", "changed", "prev", "n", "a", "t", "own_value", "best_gain", "best_c"]
    assert rows(full.assign.select(cols)) == rows(kept.assign.select(cols)) and rows(full.stats) == rows(kept.stats)
    # After the first half-pass statistics stand that self-loops aren't in: the second one makes all messages anew.
    assert kept.sent_rows[1] == level.sym_rows or graph != "odd"
    level.release()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached


@pytest.mark.parametrize("graph,least", [("part_supp", 0), ("part_supp", 40), ("odd", 5)])
def test_broadcast_senders_shuffle_no_message(spark, graph, least):
    edges = edges_df(spark, ODD) if graph == "odd" else tables.part_supp(spark, SF001)
    level = build_level(loops.prepare_edges(edges), 8, hot_floor=100 if graph == "odd" else 300)
    assert level.partitions > 1 and not level.salted and loops._in_place(spark, level, level.vertices) == 0
    degrees = [r.deg_cnt for r in level.vert.collect()]
    assert least == 0 or 0 < sum(d >= least for d in degrees) < len(degrees)
    assign = materialize(singleton_assignment(level))
    stats = materialize(moves.with_hot(level, initial_stats(level)))
    new, cached, parts = loops._half_pass(spark, level, assign, stats, True, level.vertices)
    state = materialize(new)
    assert state.where("changed").count() > 0
    exchanges = []
    for make in (lambda d: moves.moved_parts(level, state, parts, True, d),
                 lambda d: moves.incident_parts(level, state, moves.statistics(level, state), d)):
        assert [rows(x) for x in make(None)] == [rows(x) for x in make(least)]
        flagged = moves.flagged_parts(level, moves.vertex_table(level, state), make(least))[0]
        flagged.count()
        text = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        exchanges.append(text)
    # For the movers only tables of vertices and messages of light ones are laid out, by no exchange of Spark's.
    assert "ENSURE_REQUIREMENTS" not in exchanges[0]
    assert least or exchanges[0].count("REPARTITION_BY_NUM") == 1
    for touched in (None, moves.touched_communities(state)):
        assert rows(moves.statistics(level, state, touched, least)) == rows(moves.statistics(level, state, touched))
    assert rows(compress_edges(level, state, in_place=least)) == rows(compress_edges(level, state))
    for df in [*cached, *parts]:
        df.unpersist()
    level.release()


@pytest.mark.parametrize("few", [False, True])
def test_broadcast_senders_give_what_messages_give(spark, few, monkeypatch):
    level = build_level(loops.prepare_edges(edges_df(spark, ODD)), 8, hot_floor=70)
    assert level.partitions > 1 and not level.salted
    first = moves.with_hot(level, initial_stats(level))
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", -1.0)
    monkeypatch.setattr(loops, "_few_communities", lambda _s, _l, n: few or n <= level.vertices // 4)
    found = []
    for in_place in (None, 0, 5):
        monkeypatch.setattr(loops, "_in_place", lambda *_, in_place=in_place: in_place)
        found.append(loops.local_moving(spark, level, 0, 2000, 1, first))
    sent = found[0]
    for met in found[1:]:
        assert sent.movers == met.movers and (sent.score, sent.reported_score) == (met.score, met.reported_score)
        assert rows(sent.assign) == rows(met.assign) and rows(sent.stats) == rows(met.stats)
    level.release()


def test_heavy_senders_are_few(spark, monkeypatch):
    level = build_level(loops.prepare_edges(tables.part_supp(spark, SF001)), 8, hot_floor=300)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
        counts = [level.vert.where(f"deg_cnt >= {d}").count() for d in DEGREE_STEPS]
        assert level.counts.heavy == counts
        most = next(n for n in counts if n < level.vertices)
        monkeypatch.setattr(loops, "SENDER_BYTES", 64 * most)
        assert loops._in_place(spark, level, most) == 0
        assert loops._in_place(spark, level, most + 1) == DEGREE_STEPS[counts.index(most)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert loops._in_place(spark, level, 1) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    level.release()

"""What a half-pass doesn't do: sum messages that are one each already, encode rows that it caches for a few readers."""

import pytest

from commune.operators import moves
from commune.operators.graph import build_level, initial_stats, materialize, singleton_assignment
from commune.plans import catalog
from commune.plans import detect as loops
from commune.session import CACHE_ENCODED
from tests.conftest import SF001, edges_df

EDGES = [(a, b, (a * b) % 5 - 1) for a in range(1, 24) for b in range(a, 24, 1 + a % 4)] + [
    (5, 2, 4), (2, 5, 4), (None, 4, 1), (4, None, 2), (None, None, 3)] + [(100, 101 + k, 1) for k in range(200)]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("hot_floor", [300, 1])
def test_messages_of_single_vertices_are_taken_as_they_are(spark, hot_floor):
    level = build_level(loops.prepare_edges(edges_df(spark, EDGES)), 8, hot_floor=hot_floor)
    assert level.partitions > 1 and level.salted == (hot_floor == 1)
    assign = singleton_assignment(level)
    for stats in (None, materialize(moves.with_hot(level, initial_stats(level)))):
        for in_place in (None,) if level.salted else (None, 0, 10):
            summed = moves.incident_parts(level, assign, stats, in_place)
            single = moves.incident_parts(level, assign, stats, in_place, single=True)
            assert [rows(p) for p in single] == [rows(p) for p in summed]
            assert [p.dtypes for p in single] == [p.dtypes for p in summed]
            assert "HashAggregate" in summed[0]._jdf.queryExecution().executedPlan().toString()
            assert "HashAggregate" not in single[0]._jdf.queryExecution().executedPlan().toString()
            if level.salted:
                continue
            # They are met by their receivers in their layout, as sums are.
            flagged = moves.flagged_parts(level, moves.vertex_table(level, assign), single)[0]
            flagged.count()
            text = flagged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "ENSURE_REQUIREMENTS" not in text
    level.release()


def test_only_the_first_half_pass_has_single_vertices_and_no_cached_rows_are_encoded(spark, monkeypatch):
    encoded, single = [], []
    persist, incident_parts = type(spark.range(1)).persist, moves.incident_parts

    def noted_persist(df, *level):
        encoded.append(spark.conf.get(CACHE_ENCODED))
        return persist(df, *level)

    def noted_parts(*given, **named):
        single.append(named.get("single", given[4] if len(given) > 4 else False))
        return incident_parts(*given, **named)

    monkeypatch.setattr(type(spark.range(1)), "persist", noted_persist)
    monkeypatch.setattr(moves, "incident_parts", noted_parts)
    monkeypatch.setattr(loops, "FRONTIER_MOVERS", -1.0)
    monkeypatch.setattr(loops, "KEPT_ROWS", -1.0)
    before = spark.conf.get(CACHE_ENCODED)
    level = build_level(loops.prepare_edges(edges_df(spark, EDGES)), 8, hot_floor=300)
    out = loops.local_moving(spark, level, 0, 2000, 1, moves.with_hot(level, initial_stats(level)))
    assert single == [True] + [False] * (out.half_passes - 1) and out.half_passes > 2
    assert len(encoded) > out.half_passes and set(encoded) == {"false"}
    assert spark.conf.get(CACHE_ENCODED) == before
    level.release()


def test_what_hooks_were_given_can_be_read_after_three_levels(spark):
    given = catalog.q_level_hooks(spark, SF001).groupBy("hook", "level").count().collect()
    vertices = {r["count"] for r in given if r["hook"] == "membership"}
    assert len(vertices) == 1 and sorted(r["level"] for r in given if r["hook"] == "membership") == [0, 1, 2]
    assert sorted(r["level"] for r in given if r["hook"] != "membership") == [0, 1, 2, 2]

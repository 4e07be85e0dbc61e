"""Messages are shuffled once however many communities there are, and a level's pairs stand once."""

import pytest

from commune.operators import compress, moves
from commune.operators.graph import (both_ways, build_level, initial_stats, materialize, singleton_assignment,
                                     symmetrize, undirected)
from commune.plans import catalog
from commune.plans import detect as loops
from commune.sources import tables
from tests.conftest import SF001, edges_df

EDGES = [(1, 2, 1), (2, 1, 3), (2, 2, 5), (2, 3, 1), (3, 4, 2), (3, 4, 2), (None, 3, 1), (3, None, 4), (None, None, 2),
         (4, 5, 1), (5, 6, 1), (4, 6, 7), (6, 6, 1), (6, 7, 1)]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def looked_up(monkeypatch):
    """Columns of the rows that are joined by key without regard to the level's layout."""
    seen = []
    real = moves.lookup

    def noted(facts, *rest, **named):
        seen.append(facts.columns)
        return real(facts, *rest, **named)

    monkeypatch.setattr(moves, "lookup", noted)
    return seen


def test_pairs_stand_once(spark):
    level = build_level(loops.prepare_edges(edges_df(spark, EDGES)), 4)
    assert level.pairs.count() == 11 and level.sym.count() == level.sym_rows == 19
    wanted = {}
    for s, d, w in EDGES:
        for pair in ((s, d), (d, s)):
            wanted[pair] = wanted.get(pair, 0) + w
    got = {(r.id, r.nbr): r.w for r in symmetrize(edges_df(spark, EDGES)).collect()}
    assert got == wanted and both_ways(undirected(edges_df(spark, EDGES))).count() == len(wanted)
    level.release()


def test_line_items_make_the_level_of_part_supp(spark):
    summed, items = (build_level(loops.prepare_edges(f(spark, SF001)), 4)
                     for f in (tables.part_supp, tables.part_supp_items))
    assert rows(summed.vert) == rows(items.vert) and rows(summed.pairs) == rows(items.pairs)


@pytest.mark.parametrize("hot_floor", [50_000, 300, 1])
def test_carried_statistics_equal_broadcast_ones(spark, hot_floor, looked_up, monkeypatch):
    level = build_level(loops.prepare_edges(tables.part_supp(spark, SF001)), 16, hot_floor=hot_floor)
    assign = materialize(singleton_assignment(level))
    first = materialize(moves.with_hot(level, initial_stats(level)))
    found = []
    for few in (True, False):
        monkeypatch.setattr(loops, "_few_communities", lambda *_, few=few: few)
        state = assign
        looked_up.clear()
        for k, stats in enumerate((first, None, None)):
            new, cached = loops.half_pass(spark, level, state, stats, k % 2 == 0, level.vertices)
            state = materialize(new)
            for df in cached:
                df.unpersist()
        # Without a broadcast, only rows of vertices are dealt by community.
        assert few or not any("inc_w" in columns for columns in looked_up)
        found.append(rows(state))
    assert found[0] == found[1]
    flagged, stats = loops.observe(level, state)
    assert rows(moves.statistics(level, state)) == rows(stats)
    assert rows(compress.compress_edges(level, state)) == rows(compress.compress_edges(level, state, flagged))
    level.release()


def test_broadcast_only_what_a_partition_could_hold(spark):
    level = build_level(loops.prepare_edges(tables.part_supp(spark, SF001)), 16, hot_floor=300)
    assert level.partitions > 1
    share = level.sym_rows // level.partitions
    assert loops._few_communities(spark, level, share) and not loops._few_communities(spark, level, share + 1)
    level.release()


@pytest.mark.parametrize("query", [catalog.q_stay_gain, catalog.q_best_move])
def test_decision_queries_deal_no_messages_by_community(spark, query, looked_up):
    assert query(spark, SF001).count() > 0
    assert looked_up and not any("inc_w" in columns for columns in looked_up)

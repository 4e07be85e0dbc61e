"""Toy graphs with hand-derived expected results."""

import pytest

from commune.plans.detect import detect
from tests.conftest import edges_df

PATH = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1)]
TRI = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]
MIX = [(1, 2, 1), (1, 2, 1), (2, 1, 3), (3, 3, 2), (2, 3, 1)]
RING6 = [e for i in range(6) for e in ((3 * i + 1, 3 * i + 2, 1), (3 * i + 2, 3 * i + 3, 1), (3 * i + 1, 3 * i + 3, 1),
                                       (3 * i + 3, 3 * ((i + 1) % 6) + 1, 1))]


def members(result, level=0):
    out = {}
    for r in result.membership.where(f"level = {level}").collect():
        out.setdefault(r.community, set()).add(r.vertex)
    return out


def stats(outcome):
    return {r.community: (r.n, r.a, r.t) for r in outcome.stats.collect()}


@pytest.mark.parametrize("cfg", [(2000, 1), (0, 4)])
def test_path(spark, cfg):
    r = detect(spark, edges_df(spark, PATH), *cfg)
    o = r.outcomes[0]
    assert o.movers == [2, 1, 0, 0] and o.passes == 2 and len(r.outcomes) == 1
    assert members(r) == {1: {1, 2}, 4: {3, 4, 5}}
    assert stats(o) == {1: (2, 1, 2), 4: (3, 2, 3)}
    assert o.score == pytest.approx(0.466666666667) and o.reported_score == pytest.approx(0.293333333333)


def test_tri_two_levels(spark):
    r = detect(spark, edges_df(spark, TRI), 2000, 2)
    o0, o1 = r.outcomes
    assert o0.movers == [3, 1, 1, 0, 0, 0] and o0.passes == 3
    assert members(r, 0) == {1: {1, 2, 3}, 5: {4, 5, 6}}
    assert stats(o0) == {1: (3, 3, 4), 5: (3, 3, 4)}
    assert o1.movers == [0, 0] and o1.passes == 1
    assert members(r, 1) == {1: {1, 2, 3}, 5: {4, 5, 6}}
    assert o1.score == pytest.approx(0.75) and o1.reported_score == pytest.approx(0.428571428571)
    lv = {x.level: x for x in r.levels.collect()}
    assert sorted(lv) == [0, 1] and lv[0].best_level


def test_mix_parallel_edges_self_loop(spark):
    r = detect(spark, edges_df(spark, MIX), 2000, 1)
    o = r.outcomes[0]
    assert o.movers == [2, 0, 0, 0]
    assert members(r) == {1: {1, 2}, 2: {3}}
    assert stats(o) == {1: (2, 5, 6), 2: (1, 2, 3)}
    assert o.score == pytest.approx(2.777777777778) and o.reported_score == pytest.approx(1.515151515152)


def test_ring_of_triangles(spark):
    r = detect(spark, edges_df(spark, RING6), 2000, 2)
    o = r.outcomes[0]
    assert o.movers == [6, 6, 0, 0] and len(r.outcomes) == 1
    assert sorted(members(r)) == [2, 5, 8, 11, 14, 17]
    assert all(v == (3, 3, 5) for v in stats(o).values())
    assert o.score == pytest.approx(0.6) and o.reported_score == pytest.approx(0.375)


def test_empty(spark):
    r = detect(spark, edges_df(spark, []), 2000, 1)
    assert r.membership.count() == 0 and [x.score for x in r.levels.collect()] == [0.0]


def test_self_loops_drop_equals_prefiltered_edges(spark):
    a = detect(spark, edges_df(spark, MIX), 2000, 1, self_loops="drop")
    b = detect(spark, edges_df(spark, [e for e in MIX if e[0] != e[1]]), 2000, 1)
    assert sorted(tuple(r) for r in a.membership.collect()) == sorted(tuple(r) for r in b.membership.collect())
    assert a.outcomes[0].reported_score == b.outcomes[0].reported_score

"""Full runs on graphs derived from the test tables, with independently computed results."""

import pytest

from commune.plans.detect import detect
from commune.sources import tables
from tests.conftest import SF001, SF01


def summary(r):
    return [(o.communities, round(o.reported_score, 12), o.passes) for o in r.outcomes]


def test_part_supp_level0_default(spark):
    r = detect(spark, tables.part_supp(spark, SF01), 2000, 1)
    o = r.outcomes[0]
    assert o.movers == [100, 1020, 1290, 982]
    assert (o.communities, round(o.reported_score, 12), round(o.score, 12)) == (171, 0.008099999633, 0.008413863124)
    assert len(r.outcomes) == 1


def test_part_supp_two_levels(spark):
    r = detect(spark, tables.part_supp(spark, SF01), 2000, 2)
    assert r.outcomes[0].movers == [100, 1020, 1290, 982, 918, 919]
    assert r.outcomes[1].movers == [23, 25, 26, 14, 13, 12]
    assert summary(r) == [(161, 0.008108534638, 3), (113, 0.007935954523, 3)]
    # membership partitions the vertex set at every level
    m = r.membership
    assert m.groupBy("level").count().orderBy("level").collect()[1]["count"] == 2100
    assert m.select("level", "vertex").distinct().count() == 4200


@pytest.mark.parametrize("graph,expected", [
    ("part_supp", [(12, 0.055116733564), (1, 0.136705399863), (1, None)]),
    ("copart_adj", [(79, 0.082736746831), (68, 0.083559217584), (68, None)]),
])
def test_small_multilevel(spark, graph, expected):
    r = detect(spark, getattr(tables, graph)(spark, SF001), 2000, 2)
    got = [(o.communities, round(o.reported_score, 12)) for o in r.outcomes]
    assert len(got) == len(expected)
    for (c, s), (ec, es) in zip(got, expected):
        assert c == ec
        if es is not None:
            assert s == es
    assert r.outcomes[-1].passes == 1


def test_nation_trade_dense(spark):
    r = detect(spark, tables.nation_trade(spark, SF01), 2000, 2)
    o0 = r.outcomes[0]
    assert o0.movers == [14, 10, 3, 0, 0, 0]
    assert o0.communities == 1 and round(o0.reported_score, 9) == 100.0
    assert len(r.outcomes) == 2 and r.outcomes[1].passes == 1

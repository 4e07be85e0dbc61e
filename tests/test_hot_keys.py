"""Hubs at both ends of an edge and giant communities: whole results, bounded groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from commune.operators import graph
from commune.operators.compress import compress_edges_by_triplets
from commune.sources import sinks
from tests.conftest import edges_df


@pytest.fixture
def no_broadcast(spark):
    """Only tables with the ``broadcast`` hint are broadcast, and no partitions are merged, as at scale."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for values in (small, before):
        for k, v in values.items():
            spark.conf.set(k, v)
        if values is small:
            yield


def hub_edges():
    """A third of the rows copies of one pair of hubs, others with a hub at either end, loops, a few without."""
    rng = random.Random(3)
    rows = [(1, 2, 5)] * 400 + [(1, rng.randrange(10, 300), 1) for _ in range(300)]
    rows += [(rng.randrange(10, 300), 2, 2) for _ in range(300)] + [(1, 1, 7)] * 40
    rows += [(rng.randrange(10, 300), rng.randrange(10, 300), 3) for _ in range(200)]
    return rows + [(1, 999, 1), (999, 2, 1), (5, 6, 1)]  # 999, 5 and 6 have no label


def labels(spark):
    return spark.createDataFrame([(i, i % 7 if i != 20 else None) for i in [1, 2, *range(10, 300)]],
                                 "id BIGINT, community BIGINT")


@pytest.mark.parametrize("floor", [1, 10**6])
def test_triplets_with_hubs_at_both_ends(spark, no_broadcast, floor):
    rows, label = hub_edges(), {r.id: r.community for r in labels(spark).collect()}
    expected = Counter((s, d, w, label[s], label[d]) for s, d, w in rows if s in label and d in label)
    got = graph.triplets(edges_df(spark, rows), labels(spark), 8, floor)
    assert Counter(map(tuple, got.collect())) == expected


def test_an_edge_between_hubs_or_without_a_label_of_its_hub(spark, no_broadcast):
    edges = edges_df(spark, hub_edges())
    assert {r.id for r in graph.hub_ends(edges, 8, 1).collect()} == {1, 2}
    assert graph.hub_ends(edges, 8, 10**6) is None and graph.hub_ends(edges.limit(0), 8, 1) is None
    unlabelled = labels(spark).where("id <> 1")
    assert graph.triplets(edges, unlabelled, 8, 1).where("src = 1 OR dst = 1").count() == 0
    assert graph.triplets(edges, unlabelled, 8, 1).where("dst = 2").count() == 300


def test_hubs_are_not_dealt_to_one_task(spark, no_broadcast):
    """What the shuffles of the joins carry: no task gets a hub's rows."""
    edges = edges_df(spark, hub_edges())
    found = graph.triplets(edges, labels(spark), 8, 1)
    tasks = Counter(r.p for r in found.where("src <> 1 OR dst <> 2").select(
        F.spark_partition_id().alias("p")).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("salt") > 0
    assert max(tasks.values()) < 300


def test_compression_by_triplets_with_hubs(spark, no_broadcast, monkeypatch):
    rows, label = hub_edges(), {r.id: r.community for r in labels(spark).collect()}
    expected = Counter()
    for s, d, w in rows:
        a, b = label.get(s), label.get(d)
        if a is not None and b is not None and a != b:
            expected[min(a, b), max(a, b)] += w
    monkeypatch.setattr(graph, "hot_threshold", lambda total, partitions, floor: 200)
    got = compress_edges_by_triplets(edges_df(spark, rows), labels(spark))
    assert {(r.src, r.dst): r.weight for r in got.collect()} == expected


def clustered(spark):
    """Clustered ids as in derived graphs: 1.., and from 10^9 on; a second, smaller giant, and small groups."""
    rows = [(0, v, 1) for v in [*range(1, 2001), *range(10**9, 10**9 + 1000), *range(2**62, 2**62 + 4096 * 500, 4096)]]
    rows += [(0, v, 2) for v in range(0, 5000, 10)] + [(1, v, 1) for v in range(30)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "level INT, vertex BIGINT, community BIGINT"), rows


@pytest.mark.parametrize("per_part", [20, 100, 700])
def test_clustered_ids_are_cut_into_even_parts(spark, no_broadcast, per_part):
    membership, rows = clustered(spark)
    sizes = []
    expected = {}
    for level, v, c in rows:
        expected.setdefault((level, c), []).append(v)
    got = {(r.level, r.community): (r.size, r.members) for r in sinks.community_rows(membership, per_part).collect()}
    assert got == {k: (len(v), ",".join(map(str, sorted(v)))) for k, v in expected.items()}
    split = sinks._sizes(membership).where(F.col("size") > per_part).select(
        "level", "community", sinks._parts(per_part).alias("parts"))
    most = split.agg(F.max("parts")).first()[0]
    large = sinks._with_split(membership, split, 2, 1).where(F.col("parts").isNotNull())
    for r in sinks._cuts(large, most).collect():
        members = sorted(expected[r.level, r.community])
        sizes += Counter(sum(c <= v for c in r.cuts) for v in members).values()
        assert r.cuts == sorted(r.cuts) and r.strides == r.cuts[sinks.STRIDE - 1::sinks.STRIDE]
    assert max(sizes) <= 1.5 * per_part + 2


@pytest.mark.parametrize("per_part", [20, 700])
def test_member_lists_without_a_broadcast(spark, no_broadcast, per_part):
    membership, rows = clustered(spark)
    found = sinks.member_lists(membership, per_part).collect()
    assert sorted((r.level, v, r.community) for r in found for v in r.members) == sorted(rows)
    assert max(r.size for r in found) < 3 * per_part

import os
import subprocess
import sys

import pytest

from commune.plans.job import run_job
from commune.streaming import edge_stream


def test_job_writes_levels(spark, tmp_path):
    src = tmp_path / "edges.txt"
    src.write_text("1 2\n2 3\n1 3\n4 5\n5 6\n4 6\n3 4\n")
    out = str(tmp_path / "out")
    r = run_job(spark, str(src), out, edge_delimiter=" ", min_progress=2000, progress_counter=2,
                fmt="text", member_lists=True)
    assert len(r.outcomes) == 2
    assert os.path.isdir(f"{out}/level_0_vertices") and os.path.isdir(f"{out}/level_1_vertices")
    lines = spark.read.text(f"{out}/level_0_vertices").collect()
    assert len(lines) == 6 and lines[0].value.startswith("(")
    lv = spark.read.parquet(f"{out}/levels").orderBy("level").collect()
    assert [x.level for x in lv] == [0, 1]
    mapped = {r.value for r in spark.read.text(f"{out}/members/level=0").collect()}
    assert {"1: 1,2,3", "5: 4,5,6"} <= mapped


def test_edge_stream_parses_new_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("1,2\n2,3,4\nbad\n")
    edges, rejects = edge_stream(spark, str(d))
    q = edges.writeStream.format("memory").queryName("stream_edges").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM stream_edges").collect())
    assert got == [(1, 2, 1), (2, 3, 4)]


def test_member_lists_split_large_communities(spark):
    from commune.sources.sinks import member_lists
    m = spark.range(0, 1000).selectExpr("0 AS level", "id AS vertex", "CAST(id % 2 AS BIGINT) AS community")
    parts = member_lists(m, max_per_part=100).collect()
    assert all(len(p.members) < 200 for p in parts)            # 500 members each, 5 hash parts
    assert {p.part for p in parts if p.community == 0} == set(range(5))
    every = sorted(v for p in parts for v in p.members)
    assert every == list(range(1000))


def test_community_members_are_one_row_of_any_size(spark, monkeypatch):
    from types import SimpleNamespace

    from commune.plans import catalog
    from commune.sources.sinks import MAX_PER_PART
    n = 2 * MAX_PER_PART + 2
    m = spark.range(0, n).selectExpr("0 AS level", "id AS vertex", "CAST(id % 2 AS BIGINT) AS community")
    monkeypatch.setattr(catalog, "_multilevel", lambda *_: SimpleNamespace(membership=m))
    rows = sorted(map(tuple, catalog.CATALOG["community_members"](spark, "").collect()))
    assert rows == [(0, c, n // 2, ",".join(map(str, range(c, n, 2)))) for c in (0, 1)]


@pytest.mark.parametrize("max_per_part", [1, 3, 1000])
def test_community_rows_do_not_depend_on_the_parts(spark, max_per_part):
    from commune.sources.sinks import community_rows
    groups = {(0, 1): [-5, 3, 20, 100, 1000, 2**62, 2**62 + 1, -2**63, 2**63 - 1], (0, 2): [7], (1, 1): list(range(50)),
              (1, 9): [10, 11, 12, 900_000, 900_001, 900_002, 900_003]}
    m = spark.createDataFrame([(l, v, c) for (l, c), found in groups.items() for v in reversed(found)],
                              "level int, vertex bigint, community bigint")
    rows = sorted(map(tuple, community_rows(m, max_per_part).collect()))
    assert rows == sorted((l, c, len(v), ",".join(map(str, sorted(v)))) for (l, c), v in groups.items())


@pytest.mark.parametrize("start", [["PATH/commune/plans/job.py"], ["-m", "commune.plans.job"]])
def test_command_line_runs_from_another_folder(spark, tmp_path, start):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "edges.txt").write_text("1 2\n2 3\n1 3\n4 5\n5 6\n4 6\n3 4\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if start[0] == "-m":
        env["PYTHONPATH"] = root
    env["PYSPARK_SUBMIT_ARGS"] = ("--master local[2] --conf spark.ui.enabled=false --conf spark.driver.memory=1g "
                                  "pyspark-shell")
    done = subprocess.run([sys.executable, *[x.replace("PATH", root) for x in start], "edges.txt", "out", "-d", " "],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert spark.read.parquet(str(tmp_path / "out" / "levels")).first().communities == 2
    assert spark.read.parquet(str(tmp_path / "out" / "membership")).count() == 6

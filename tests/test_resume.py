"""A run that is lost goes on from its last commit and gives what an undisturbed run gives."""

import os
import subprocess
import sys

import pytest

from commune.plans import job
from commune.plans.detect import detect
from commune.plans.journal import Journal
from commune.session import ensure_checkpoint_dir
from tests.conftest import edges_df

TOY = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]


class Lost(Exception):
    pass


class LostAfter(Journal):
    """Loses the run at one commit: just before it stands, or just after."""

    def __init__(self, *args, at: int, stands: bool):
        super().__init__(*args)
        self.left, self.stands = at, stands

    def commit(self, state):
        self.left -= 1
        if self.left or self.stands:
            super().commit(state)
        if not self.left:
            raise Lost


def rows(df):
    return sorted(map(tuple, df.collect()))


def facts(result):
    return (rows(result.membership), rows(result.state), rows(result.levels),
            [(o.movers, o.message_rows, o.passes, o.guarded) for o in result.outcomes])


def test_a_lost_run_goes_on_from_its_last_commit(spark, tmp_path):
    edges = edges_df(spark, TOY)
    whole = detect(spark, edges, 2000, 2, partitions=1)
    expected = facts(whole)
    first, second = (o.passes for o in whole.outcomes)
    level, end = first + 2, first + second + 3
    # Between passes, after the first level's end, after the last level.
    for at, stands, called in [(3, True, [0, 1]), (level, True, [1]), (end, True, [])]:
        folder = f"{tmp_path}/journal-{at}-{stands}"
        with pytest.raises(Lost):
            detect(spark, edges, 2000, 2, partitions=1, journal=LostAfter(spark, folder, {}, at=at, stands=stands))
        levels = []
        # Another number of partitions may lay the same tables out anew.
        again = detect(spark, edges, 2000, 2, partitions=1 if at > 3 else 2, journal=Journal(spark, folder, {}),
                       on_level=lambda n, *_: levels.append(n))
        assert facts(again) == expected
        assert levels == called
        again.release()
    whole.release()


def test_a_journal_refuses_another_run_and_forgets_its_tables(spark, tmp_path):
    folder, edges = f"{tmp_path}/journal", edges_df(spark, TOY)
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with pytest.raises(Lost):
        detect(spark, edges, 2000, 2, journal=LostAfter(spark, folder, {"input": "a", "x": 1}, at=2, stands=True))
    with pytest.raises(ValueError, match="differs in input"):
        Journal(spark, folder, {"input": "b", "x": 1}).last()
    assert len([f for f in os.listdir(folder) if f.endswith(".json")]) == 1
    assert set(os.listdir(root)) - before
    Journal(spark, folder, {"input": "b", "x": 1}).forget()
    assert not os.path.exists(folder)
    assert set(os.listdir(root)) == before


def test_an_empty_graph_leaves_no_commit(spark, tmp_path):
    journal = Journal(spark, f"{tmp_path}/journal", {})
    assert detect(spark, edges_df(spark, []), journal=journal).outcomes == []
    assert journal.last() is None


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from commune.plans import job
from commune.plans.journal import Journal
commit, made = Journal.commit, []
def killed(self, state):
    commit(self, state)
    made.append(state)
    if len(made) == 3:
        os._exit(9)
Journal.commit = killed
job.main({args!r})
"""


def test_a_killed_driver_is_resumed_by_another(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    src, out, alone, shared = (f"{tmp_path}/{n}" for n in ("edges", "out", "alone", "shared"))
    with open(src, "w") as file:
        file.writelines(f"{s},{d},{w}\n" for s, d, w in TOY)
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false "
           "--conf spark.driver.memory=1g --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    args = [src, out, "-x", "2000", "-y", "2", "--checkpoint-dir", shared]
    killed = subprocess.run([sys.executable, "-c", KILLED.format(root=root, args=args)], cwd=tmp_path, env=env,
                            capture_output=True, text=True, timeout=300)
    assert killed.returncode == 9, killed.stderr[-2000:]
    assert not os.path.exists(f"{out}/levels")
    options = {"min_progress": 2000, "progress_counter": 2}
    with pytest.raises(ValueError, match="min_progress"):
        job.run_job(spark, src, out, min_progress=1, progress_counter=2, resume=True)
    again = job.run_job(spark, src, out, **options, resume=True)
    whole = job.run_job(spark, src, alone, **options)
    assert facts(again) == facts(whole)
    for made in ("levels", "membership", "level_0_vertices"):
        assert rows(spark.read.parquet(f"{out}/{made}")) == rows(spark.read.parquet(f"{alone}/{made}"))
    assert not os.path.exists(f"{out}/_journal")

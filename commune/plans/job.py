"""Batch job: edge-list text -> multi-level communities -> per-level outputs.

    spark-submit commune/plans/job.py <input> <output> [-d DELIM] [-x MIN_PROGRESS]
        [-y PROGRESS_COUNTER] [-z] [-p PARALLELISM] [--partitions N] [--checkpoint-dir DIR]
        [--format parquet|text] [--member-lists] [--members-per-part N] [--max-half-passes N] [--resume]

Master, application name, jars and Spark properties are ``spark-submit``'s own options. The file may
be run by its path from any folder; installed, the job is ``commune-detect`` or
``python -m commune.plans.job``. Only the driver imports the package: executors run no Python here. Every
level's state, membership and member lists are written as soon as the level is finished. A run commits
its progress to ``<output>/_journal``; with ``--resume`` it goes on from the last commit that a lost
driver left there, provided that the checkpoint folder still stands.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

if not __package__:  # run by its path: the folder of the package isn't on the module path then
    sys.path[0] = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from commune.plans.detect import MAX_HALF_PASSES, Result, detect
from commune.plans.journal import Journal
from commune.session import ensure_checkpoint_dir
from commune.sources.edges import read_edges
from commune.sources.sinks import (MAX_PER_PART, clear_levels, write_level_state, write_levels, write_membership)

log = logging.getLogger("commune.job")


def input_facts(spark: SparkSession, path: str) -> dict:
    """The input's path, files and bytes: another input is not taken for the one a run began with."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [fs.getContentSummary(s.getPath()) for s in fs.globStatus(pattern) or []]
    return {"path": path, "files": sum(f.getFileCount() for f in found), "bytes": sum(f.getLength() for f in found)}


def run_job(spark: SparkSession, input_path: str, output: str, edge_delimiter: str = ",",
            min_progress: int = 2000, progress_counter: int = 1, ip_address: bool = False,
            parallelism: int = -1, fmt: str = "parquet", member_lists: bool = False,
            self_loops: str = "keep", scan_mode: str = "fail", partitions: int | None = None,
            checkpoint_dir: str | None = None, max_per_part: int = MAX_PER_PART,
            max_half_passes: int = MAX_HALF_PASSES, resume: bool = False) -> Result:
    """Scan, detect, and write every level as soon as it is finished.

    With ``resume`` a run goes on from the last commit in ``<output>/_journal``, if there is one (ValueError if it
    is of another input or other options); else commits found there are deleted with their tables.
    """
    t0 = time.time()
    ensure_checkpoint_dir(spark, checkpoint_dir)
    journal = Journal(spark, f"{output}/_journal", {
        "input": input_facts(spark, input_path), "edge_delimiter": edge_delimiter, "ip_address": ip_address,
        "min_progress": min_progress, "progress_counter": progress_counter, "self_loops": self_loops,
        "scan_mode": scan_mode, "max_half_passes": max_half_passes, "format": fmt, "member_lists": member_lists,
        "max_per_part": max_per_part})
    if not resume:
        journal.forget()
    scan = read_edges(spark, input_path, edge_delimiter, ip_address, scan_mode, parallelism)
    if scan.rejects is not None:
        scan.rejects.write.mode("overwrite").parquet(f"{output}/rejects")

    def on_level(level: int, score: float, state) -> None:
        write_level_state(state, output, level, fmt)
        log.info("level %d written, reported score %.9f", level, score)

    def on_membership(level: int, rows) -> None:
        write_membership(rows, output, level, member_lists, fmt, max_per_part)

    result = detect(spark, scan.edges, min_progress, progress_counter, self_loops=self_loops, on_level=on_level,
                    on_membership=on_membership, partitions=partitions, max_half_passes=max_half_passes,
                    journal=journal)
    clear_levels(spark, output, max(len(result.outcomes) - 1, 0))
    write_levels(result.levels, output)
    journal.close()
    log.info("finished after %d s", int(time.time() - t0))
    return result


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="commune", description="Multi-level CEIL community detection")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-p", "--parallelism", type=int, default=-1, help="repartition the edges into N partitions")
    p.add_argument("-x", "--minprogress", type=int, default=2000,
                   help="a pass counts as no progress unless movers drop by more than this")
    p.add_argument("-y", "--progresscounter", type=int, default=1,
                   help="passes without progress tolerated before a level ends")
    p.add_argument("-d", "--edgedelimiter", default=",", help="edge delimiter (a regular expression)")
    p.add_argument("-z", "--ipaddress", action="store_true", help="ids are IPv4 dotted quads")
    p.add_argument("--format", choices=("parquet", "text"), default="parquet")
    p.add_argument("--member-lists", action="store_true", help="also write community member lists")
    p.add_argument("--members-per-part", type=int, default=MAX_PER_PART,
                   help="members in one part of a member list, about")
    p.add_argument("--self-loops", choices=("keep", "drop"), default="keep")
    p.add_argument("--quarantine", action="store_true", help="write malformed lines to <output>/rejects")
    p.add_argument("--partitions", type=int, help="partitions of a level's edges (default: shuffle partitions)")
    p.add_argument("--checkpoint-dir", help="folder that driver and executors share (default: spark.checkpoint.dir)")
    p.add_argument("--max-half-passes", type=int, default=MAX_HALF_PASSES,
                   help="half-passes after which a level that never settles is stopped and reported")
    p.add_argument("--resume", action="store_true", help="go on from the last commit of a run that was lost")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("commune").getOrCreate()
    run_job(spark, a.input, a.output, a.edgedelimiter, a.minprogress, a.progresscounter, a.ipaddress,
            a.parallelism, a.format, a.member_lists, a.self_loops, "quarantine" if a.quarantine else "fail",
            a.partitions, a.checkpoint_dir, a.members_per_part, a.max_half_passes, a.resume)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

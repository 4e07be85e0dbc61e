"""Driver loops: local moving within a level, compression, and the multi-level run.

The loops only decide when to stop; every step is a DataFrame job. A half-pass is one job: the
new state is checkpointed to the shared checkpoint folder, which cuts the plan and survives
executor loss, and the movers are counted by the same job (observed metrics). A state's checkpoint
is deleted once the next one stands, a level's once it is compressed.

With a journal, a run commits after every whole pass and every level and goes on from its last commit.

When few vertices moved, the next half-pass makes messages for the frontier only; when the movers have at most
half of the edges, it takes the incident rows of the half-pass before and makes messages of the movers
only (see ``commune.operators.moves``). Senders few enough are broadcast to the edges. All ways give the same rows.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commune.operators import moves
from commune.operators.compress import compress_edges, compress_vertices
from commune.operators.graph import (DEFAULT_HOT_FLOOR, Level, build_level, initial_stats, materialize,
                                     materialize_observed, reopen_level, reopen_table, singleton_assignment,
                                     table_record)
from commune.operators.skew import hot_threshold, lookup
from commune.plans.journal import Journal
from commune.session import broadcast_ok, cache, discard, ensure_checkpoint_dir, shuffle_partitions

log = logging.getLogger("commune.detect")

# The guard of the half-pass loop (an argument of ``detect`` and the job; a level it
# stops is reported) and the score threshold of the multi-level test.
MAX_HALF_PASSES = 100_000
IMPROVEMENT_EPS = 1e-7
# A frontier half-pass is tried after at most this share of vertices moved, and made if the frontier
# has at most this share of the rows. Results don't depend on either.
FRONTIER_MOVERS, FRONTIER_ROWS = 1 / 20, 1 / 4
# Incident rows are kept for the next half-pass if the movers have at most this share of the rows, for so many
# half-passes in a row: the tables behind them stand as long, so that a lost block can be made anew, and plans
# show all of them.
KEPT_ROWS, KEPT_HALF_PASSES = 1 / 2, 4
# Statistics are broadcast up to so many bytes (a million communities), more than Spark would broadcast unasked.
STATS_BYTES = 64 << 20
# So are senders (see ``moves.met_in_place``): a million, or fewer with the statistics they carry.
SENDER_BYTES = 64 << 20


@dataclass
class LevelOutcome:
    level: int
    assign: DataFrame          # state of the last half-pass (see ``moves.decide``), checkpointed
    stats: DataFrame           # (community, n, a, t, vol_rows, members, hot), checkpointed
    passes: int
    half_passes: int
    movers: list[int]
    message_rows: list[int]    # rows of ``sym`` that each half-pass made messages of
    score: float
    reported_score: float
    communities: int
    seconds: float
    guarded: bool = False      # stopped by ``max_half_passes``, not by lack of progress
    sent_rows: list[int] = field(default_factory=list)  # messages that each half-pass made, hubs' before they are summed

    def record(self) -> dict:
        """The outcome as JSON values; ``reopen`` makes it of them again."""
        plain = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("assign", "stats")}
        return {**plain, "assign": table_record(self.assign), "stats": table_record(self.stats)}

    @classmethod
    def reopen(cls, spark: SparkSession, record: dict) -> LevelOutcome:
        tables = {k: reopen_table(spark, record[k]) for k in ("assign", "stats")}
        return cls(**{**record, **tables})


@dataclass
class Progress:
    """Where local moving stands between two whole passes."""

    assign: DataFrame
    bound: int
    try_frontier_at: float
    movers: list[int] = field(default_factory=list)
    message_rows: list[int] = field(default_factory=list)
    sent_rows: list[int] = field(default_factory=list)
    stalls: int = 0
    previous: int = 0
    done: bool = False

    def record(self) -> dict:
        plain = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "assign"}
        return {**plain, "assign": table_record(self.assign)}

    @classmethod
    def reopen(cls, spark: SparkSession, record: dict) -> Progress:
        return cls(**{**record, "assign": reopen_table(spark, record["assign"])})


@dataclass
class Result:
    membership: DataFrame       # (level, vertex, community)
    state: DataFrame            # (level, id, community, out_w, int_n, int_w, n, t, a, changed)
    levels: DataFrame           # (level, score, reported_score, passes, communities, best_level)
    outcomes: list[LevelOutcome] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the checkpoints behind this result; its tables can't be read afterwards."""
        discard(*self.tables, *(x for o in self.outcomes for x in (o.assign, o.stats)))
        self.tables, self.outcomes = [], []


def observe(level: Level, assign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incident table (flagged) and community statistics of an assignment."""
    vertices = moves.vertex_table(level, assign)
    parts = moves.flagged_parts(level, vertices, moves.incident_parts(level, assign))
    flagged = reduce(DataFrame.unionByName, parts)
    return flagged, moves.community_stats(level, assign, flagged)


def _few_communities(spark: SparkSession, level: Level, communities_bound: int) -> bool:
    """Whether statistics are broadcast: proven small, and no more than the rows of a partition, which would else
    hold more statistics than messages."""
    return broadcast_ok(spark, communities_bound, least_limit=STATS_BYTES) and (
        communities_bound * level.partitions <= max(level.sym_rows, communities_bound))


def _in_place(spark: SparkSession, level: Level, senders: int, row_bytes: int = 64) -> int | None:
    """From how many rows a sender is broadcast to the edges instead of sending messages: 0 if all are, None if none is.

    Where ``senders`` are too many, those with the most rows are broadcast, as many as fit.
    """
    if level.partitions == 1 or level.salted or not broadcast_ok(spark, 0, row_bytes, SENDER_BYTES):
        return None
    if broadcast_ok(spark, senders, row_bytes, SENDER_BYTES):
        return 0
    return level.counts.heavy_from(SENDER_BYTES // row_bytes)


def half_pass(spark: SparkSession, level: Level, assign: DataFrame, stats: DataFrame | None, down: bool,
              communities_bound: int, front: DataFrame | None = None,
              touched: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """New state after one half-pass (lazy) and the cached tables to release after it."""
    new, cached, parts = _half_pass(spark, level, assign, stats, down, communities_bound, front, touched)
    return new, [*cached, *parts]


def _half_pass(spark: SparkSession, level: Level, assign: DataFrame, stats: DataFrame | None, down: bool,
               communities_bound: int, front: DataFrame | None = None, touched: DataFrame | None = None,
               before: list[DataFrame] | None = None,
               n_movers: int | None = None, single: bool = False) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """New state after one half-pass (lazy), the cached tables to release after it, and its (cached) incident rows.

    ``stats`` overrides the computed statistics. With ``front`` and ``touched`` the half-pass
    makes messages for the frontier only; ``assign`` is then the state of the half-pass before.

    Statistics too many to broadcast (``_few_communities``) are computed first and carried by the messages, so there is
    one message shuffle either way. With ``before``, the incident rows of the half-pass that led to ``assign``, only
    its movers (``n_movers``) send messages; statistics must then be few enough to broadcast. ``single``: see
    ``moves.incident_parts``.
    """
    vertices = moves.vertex_table(level, assign)
    broadcast = _few_communities(spark, level, communities_bound)
    if not broadcast:
        if stats is None:
            stats = moves.statistics(level, assign, touched, _in_place(spark, level, level.vertices))
        stats = cache(stats)
    carried = None if broadcast else stats
    if before is not None:
        inc = moves.moved_parts(level, assign, before, in_place=_in_place(
            spark, level, level.vertices if n_movers is None else n_movers))
    elif front is None:
        inc = moves.incident_parts(level, assign, carried, _in_place(spark, level, level.vertices,
                                                                     64 if broadcast else 96), single)
    else:
        inc = moves.frontier_parts(level, assign, front, carried)
    parts = [cache(p) for p in moves.flagged_parts(level, vertices, inc)]
    if broadcast:
        if stats is None:
            stats = moves.community_stats(level, assign, reduce(DataFrame.unionByName, parts), touched)
        stats = cache(stats)
    new, cached = moves.decide(level, vertices, parts, stats, down, broadcast, front=front)
    return new, [*cached, stats], parts


def _patched_half_pass(level: Level, assign: DataFrame, before: list[DataFrame], touched: DataFrame,
                       down: bool, in_place: int | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame], DataFrame]:
    """``_half_pass`` for statistics too many to broadcast, by those of ``touched`` communities, which are not.

    ``before`` are the incident rows of the half-pass that led to ``assign``, with the statistics it used: they stand for
    all other communities. Only its movers send messages, or are broadcast (from ``in_place`` rows on). Last is the (written) table of the touched ones' statistics.
    """
    vertices = moves.vertex_table(level, assign)
    parts = [cache(p) for p in moves.flagged_parts(level, vertices, moves.moved_parts(level, assign, before, True, in_place))]
    stats = materialize(moves.touched_stats(level, assign, reduce(DataFrame.unionByName, parts), touched))
    new, cached = moves.decide(level, vertices, parts, stats, down, broadcast_stats=False, patch=True)
    return new, cached, parts, stats


def stalled(previous: int, current: int, min_progress: int) -> bool:
    """Whether a pass whose ``current`` movers aren't fewer than ``previous`` by more than ``min_progress``."""
    return current >= previous - min_progress


def local_moving(spark: SparkSession, level: Level, level_no: int, min_progress: int = 1,
                 progress_counter: int = 1, first_stats: DataFrame | None = None,
                 max_half_passes: int = MAX_HALF_PASSES, progress: Progress | None = None,
                 on_pass: Callable[[Progress], None] | None = None) -> LevelOutcome:
    """Whole passes (one half-pass down, one up) until too many stall or nothing moves.

    ``on_pass`` gets the progress after every whole pass, while the state of the pass before still
    stands; given back as ``progress``, moving goes on from there.
    """
    t0 = time.time()
    at = progress or Progress(singleton_assignment(level), level.vertices, level.vertices * FRONTIER_MOVERS)
    movers = at.movers
    kept: list[DataFrame] | None = None  # incident rows of the half-pass before, if of all vertices
    moved_rows = generations = 0         # rows of its movers; half-passes since these rows were made of all messages
    behind: list[DataFrame | None] = []  # tables that a lost block of ``kept`` is made of
    living: DataFrame | None = None      # communities that have members, where they are too many to broadcast
    n_touched = 0                        # those among them that the half-pass before touched
    carried = False                      # whether rows of ``kept`` carry statistics
    patch: DataFrame | None = None       # statistics newer than those that they carry
    while not at.done:
        start = at.assign  # deleted only when the pass is over, see ``on_pass``
        for down in (True, False):
            front = touched = None
            rows = level.sym_rows
            # The first half-pass may have used other statistics than those of its assignment.
            few = len(movers) > 1 and movers[-1] <= at.try_frontier_at and level.partitions > 1
            if few and broadcast_ok(spark, 2 * movers[-1]):
                touched = moves.touched_communities(at.assign)
                front, seen = materialize_observed(moves.frontier(level, at.assign, touched), rows=F.sum("deg_cnt"))
                rows = int(seen["rows"] or 0)
                if rows > level.sym_rows * FRONTIER_ROWS:
                    discard(front)
                    front, touched, rows, at.try_frontier_at = None, None, level.sym_rows, movers[-1] / 2
            use = first_stats if not movers else None
            all_few = _few_communities(spark, level, at.bound)
            keep = (kept is not None and front is None and generations < KEPT_HALF_PASSES
                    and moved_rows <= level.sym_rows * KEPT_ROWS)
            # As above: what the first half-pass used stands if it is what its assignment has.
            stands = len(movers) > 1 or first_stats is None or level.counts.loops == 0
            patching = (keep and not all_few and carried and stands and living is not None
                        and _few_communities(spark, level, n_touched))
            keep = patching or keep and all_few
            newer = None
            if patching:
                before = kept if patch is None else [moves.patched(p, patch) for p in kept]
                new_assign, cached, parts, newer = _patched_half_pass(
                    level, at.assign, before, living.where("touched").select("community"), down,
                    _in_place(spark, level, movers[-1]))
            else:
                new_assign, cached, parts = _half_pass(spark, level, at.assign, use, down, at.bound, front, touched,
                                                       kept if keep else None, movers[-1] if keep else None,
                                                       not movers)
            new_assign, seen = materialize_observed(new_assign, moved=F.count(F.when(F.col("changed"), 1)),
                                                    moved_rows=F.sum(F.when(F.col("changed"), F.col("deg_cnt"))))
            at.sent_rows.append(moved_rows if keep else rows)
            moved_rows, generations = int(seen["moved_rows"] or 0), generations + 1 if keep else 0
            movers.append(int(seen["moved"]))
            at.message_rows.append(rows)
            for df in kept or []:
                df.unpersist()
            if not keep:
                discard(*behind)
                behind = []
            carried = patching or not all_few
            if patch is not None:
                behind.append(patch)
            if living is not None:
                behind.append(living)
            patch, living = newer, None
            # A level of one partition shuffles nothing.
            kept = parts if front is None and level.partitions > 1 else None
            if kept is None:
                cached = [*cached, *parts]
            if not all_few:
                # The communities of this assignment bound those of the next: none appears in a level.
                living, seen = materialize_observed(moves.living_communities(new_assign), communities=F.count(F.lit(1)),
                                                    touched=F.count_if("touched"))
                at.bound, n_touched = int(seen["communities"] or 0), int(seen["touched"] or 0)
            discard(front, *cached)
            if not down and kept is not None:
                behind.append(at.assign)
            elif not down:
                discard(at.assign)
            at.assign = new_assign
        moved = movers[-2] + movers[-1]
        at.stalls += stalled(at.previous, moved, min_progress)
        at.previous = moved
        at.done = len(movers) >= max_half_passes or moved == 0 or at.stalls > progress_counter
        if on_pass is not None:
            on_pass(at)
        behind.append(start)
        if kept is None:
            discard(*behind)
            behind = []
    discard(*(kept or []), *behind, patch, living)
    guarded = len(movers) >= max_half_passes and at.previous > 0 and at.stalls <= progress_counter
    if guarded:
        log.warning("level %d was stopped after %d half-passes with %d movers left", level_no, len(movers), at.previous)
    last = moves.statistics(level, at.assign, in_place=_in_place(spark, level, level.vertices))
    stats, bounds = materialize_observed(last, **moves.score_bounds(level.total_vertices))
    score, reported = moves.score_totals(level, stats, bounds)
    return LevelOutcome(level=level_no, assign=at.assign, stats=stats, passes=len(movers) // 2,
                        half_passes=len(movers), movers=movers, message_rows=at.message_rows, score=score,
                        reported_score=reported, communities=int(bounds["communities"]),
                        seconds=time.time() - t0, guarded=guarded, sent_rows=at.sent_rows)


def compress(level: Level, outcome: LevelOutcome, hot_floor: int = DEFAULT_HOT_FLOOR) -> Level:
    """The next level: one vertex per community, edges between communities."""
    edges = compress_edges(level, outcome.assign, in_place=_in_place(level.vert.sparkSession, level, level.vertices))
    verts = compress_vertices(outcome.stats)
    return build_level(edges, level.most_partitions, total_vertices=level.total_vertices, vertex_attrs=verts,
                       hot_floor=hot_floor)


def prepare_edges(edges: DataFrame, self_loops: str = "keep") -> DataFrame:
    """Level-0 edges as BIGINT (the level sums parallel ones); ``self_loops="drop"`` removes loops."""
    if self_loops not in ("keep", "drop"):
        raise ValueError(f"unknown self_loops {self_loops!r}")
    e = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
                     F.col("weight").cast("bigint").alias("weight"))
    if self_loops == "drop":
        e = e.where(F.col("src") != F.col("dst"))
    return e


def level_state(outcome: LevelOutcome) -> DataFrame:
    """Vertex state of a finished level (level, id, community, out_w, int_n, int_w, n, t, a, changed)."""
    st = outcome.stats.select("community", "n", "a", "t", "hot")
    rows = outcome.assign.select("id", "community", *moves.CONSTANTS, "changed")
    return (lookup(rows, st, "community")
            .select(F.lit(outcome.level).alias("level"), "id", "community", "out_w", "int_n", "int_w",
                    "n", "t", "a", "changed"))


def _first_paths(outcome: LevelOutcome) -> DataFrame:
    return outcome.assign.select(F.col("id").alias("vertex"), F.array("community").alias("path"))


LEVELS_SCHEMA = ("level INT, score DOUBLE, reported_score DOUBLE, passes INT, communities BIGINT, "
                 "best_level BOOLEAN")


def _empty_result(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership, state and levels of a graph without vertices: one level of score 0."""
    membership = spark.createDataFrame([], "level INT, vertex BIGINT, community BIGINT")
    state = spark.createDataFrame([], "level INT, id BIGINT, community BIGINT, out_w BIGINT, int_n BIGINT, "
                                      "int_w BIGINT, n BIGINT, t BIGINT, a BIGINT, changed BOOLEAN")
    return membership, state, spark.createDataFrame([(0, 0.0, 0.0, 0, 0, True)], LEVELS_SCHEMA)


def detect(spark: SparkSession, edges: DataFrame, min_progress: int = 2000, progress_counter: int = 1,
           self_loops: str = "keep", partitions: int | None = None, hot_floor: int = DEFAULT_HOT_FLOOR,
           on_level: Callable[[int, float, DataFrame], None] | None = None,
           on_final: Callable[[int, float, DataFrame], None] | None = None,
           on_membership: Callable[[int, DataFrame], None] | None = None,
           max_levels: int | None = None, max_half_passes: int = MAX_HALF_PASSES,
           compress_by: str = "reported", journal: Journal | None = None) -> Result:
    """Multi-level community detection. ``edges`` has columns src, dst, weight.

    ``partitions`` (default ``spark.sql.shuffle.partitions``) is the most that a level's edges are
    laid out over (a level takes fewer, by its rows): at scale choose it so that twice the edges over
    it fit a task. ``hot_floor`` decides from how many rows a key is spread over several tasks, and
    with it how many rows make a partition. ``max_half_passes`` stops a level that
    never settles and marks it (``LevelOutcome.guarded``). ``on_level`` gets each finished level's
    state, ``on_membership`` its (level, vertex, community) rows, ``on_final`` the last state.
    ``compress_by`` names the score that has to rise for another level: "reported" (denominator
    a + t) or "score" (denominator t).

    Communities of a vertex are kept as one array per vertex, a community per level.

    With a ``journal`` the run commits after every whole pass and every level. If the journal holds commits, the
    run goes on from the last one, with equal results, and doesn't read ``edges`` again. Hooks of
    a level whose end was not committed are called again, those of earlier levels are not.
    """
    if compress_by not in ("reported", "score"):
        raise ValueError(f"unknown score {compress_by!r}")
    ensure_checkpoint_dir(spark)
    P = partitions or shuffle_partitions(spark)
    found = journal.last() if journal is not None else None
    outcomes: list[LevelOutcome] = []
    states: list[DataFrame] = []
    paths: DataFrame | None = None  # (vertex, path): the vertex's community on each level so far
    progress: Progress | None = None
    best = 0.0
    level_no = -1
    if found is None:
        level = build_level(prepare_edges(edges, self_loops), P, hot_floor=hot_floor)
    else:
        level = reopen_level(spark, found["level"], P, hot_floor) if found["level"] else None
        outcomes = [LevelOutcome.reopen(spark, o) for o in found["outcomes"]]
        states = [level_state(o) for o in outcomes]
        if found["paths"]:
            paths = reopen_table(spark, found["paths"])
        elif outcomes:
            paths = _first_paths(outcomes[0])
        if found["progress"]:
            progress = Progress.reopen(spark, found["progress"])
        best, level_no = found["best"], len(outcomes) - 1
        log.info("going on at level %d after %d half-passes", level_no + 1, len(progress.movers) if progress else 0)

    def commit(at: Progress | None) -> None:
        if journal is not None:
            journal.commit({"level": level.record() if level else None, "outcomes": [o.record() for o in outcomes], "best": best,
                            "paths": table_record(paths) if len(outcomes) > 1 else None,
                            "progress": at.record() if at else None})

    if level is not None and level.vertices == 0:
        level.release()
        rows, state, levels = _empty_result(spark)
        if on_level is not None:
            on_level(0, 0.0, state)
        if on_membership is not None:
            on_membership(0, rows)
        if on_final is not None:
            on_final(0, 0.0, state)
        return Result(membership=rows, state=state, levels=levels, outcomes=[])
    if found is None:
        commit(None)
    while level is not None:  # after the last level, a commit has none
        level_no += 1
        first_stats = moves.with_hot(level, initial_stats(level)) if level_no == 0 else None
        out = local_moving(spark, level, level_no, min_progress, progress_counter, first_stats, max_half_passes,
                           progress, commit)
        progress = None
        outcomes.append(out)
        state = level_state(out)
        states.append(state)
        if paths is None:
            paths, shorter = _first_paths(out), None
        else:
            # Hypernodes holding more than twice a partition's share of the original vertices
            # are joined by broadcast (at most ``P / 2`` of them), the rest by shuffle.
            heavy = hot_threshold(level.total_vertices, P, hot_floor)
            dim = out.assign.select(F.col("id").alias("last"), F.col("community").alias("next"),
                                    (F.col("int_n") > F.lit(heavy)).alias("hot"))
            longer = lookup(paths.withColumn("last", F.element_at("path", -1)), dim, "last")
            longer = materialize(longer.select("vertex", F.concat("path", F.array("next")).alias("path")))
            paths, shorter = longer, paths if level_no > 1 else None
        if on_level is not None:
            on_level(level_no, out.reported_score, state)
        if on_membership is not None:
            on_membership(level_no, paths.select(F.lit(level_no).alias("level"), "vertex",
                                                 F.element_at("path", -1).alias("community")))
        reached = out.reported_score if compress_by == "reported" else out.score
        improved = out.passes > 2 and reached > best + IMPROVEMENT_EPS
        if max_levels is not None and level_no + 1 >= max_levels:
            improved = False
        best = reached if improved else best
        # All that later levels need of this one is written: its hypernodes and edges, the
        # paths, its state and statistics.
        done, level = level, compress(level, out, hot_floor) if improved else None
        commit(None)
        done.release()
        discard(shorter)
    if on_final is not None:
        on_final(level_no, best, states[-1])
    best_idx = max(range(len(outcomes)), key=lambda i: (outcomes[i].reported_score, -i))
    rows = [(o.level, o.score, o.reported_score, o.passes, o.communities, i == best_idx)
            for i, o in enumerate(outcomes)]
    levels = spark.createDataFrame(rows, LEVELS_SCHEMA)
    members = paths.select(F.posexplode("path").alias("level", "community"), "vertex").select(
        "level", "vertex", "community")
    return Result(membership=members, state=reduce(DataFrame.unionByName, states), levels=levels, outcomes=outcomes,
                  tables=[paths])

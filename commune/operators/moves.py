"""One half-pass of parallel local moving, as DataFrame operators.

Given the level's vertices with their communities:

1. ``incident_parts``: each vertex's weight towards every adjacent community. The cached ``sym``
   is joined with the assignment on ``nbr`` (it keeps its layout, so only the assignment is
   shuffled); the messages are laid out by the receiving vertex and summed there: the one
   message-sized shuffle. Hubs, of which there are at most ``partitions / 2``, are a part of their
   own: their messages are summed by ``(id, c)`` with map-side partial aggregation instead.
2. ``flagged_parts``: adds the vertex's constants and marks the row of its own community, by a join
   in that layout (hubs: by a broadcast of the hubs).
3. ``community_stats``: n, a, t per community from the vertices and their own-community
   rows: a = sum(int_w) + sum(own inc)/2, t = sum(int_w + out_w) - sum(own inc)/2.
4. ``with_gains``: the join gain of every (vertex, adjacent community), by a broadcast of the
   statistics where their size is proven. Where it isn't, ``community_stats`` can't wait for the messages:
   ``statistics`` takes them from each edge once (half a message shuffle), a sender gets those of its
   community by a skew-safe join of vertices, and the messages carry them. A skew-safe join of
   the messages themselves is left for rows that carry none (two more message shuffles).
5. ``best_moves``: per vertex the largest gain, then the largest community among those that reach
   it: two hash aggregates on primitive values in the layout by vertex, neither sorting nor
   shuffling messages.
6. ``decide``: compare with the stay value, apply the half-pass direction rule.

The flagged rows have three readers (statistics, largest gain, its community) and are cached in their
layout for the half-pass.

Senders few enough to broadcast send nothing: ``sym`` holds both directions, so it is also laid out by the receiver,
and their messages are made where they are summed (``met_in_place``). Where all are too many, those with the most
rows still are: ``in_place`` says from how many rows on, 0 for all senders, None for none of them.

They also serve the next half-pass: ``moved_parts`` adds the moves to them. A mover tells its neighbours which
community it left and which it joined, so what is shuffled is as large as the movers' edges. Weights are
integers and may be zero or negative, so a row goes when its last edge (``k``) goes, not when its weight is zero.
Statistics that the rows carry stand for all communities but the touched ones, however many there are; those of
the touched ones are broadcast and put in their place (``patched``).

A half-pass after few moves needs only the frontier. ``touched`` communities are those that a mover
left or joined; statistics and memberships of all others stand. ``frontier`` is every vertex in a
touched community or next to one. For all other vertices the value of staying and the best
candidate are those of the half-pass before, which the state carries, so messages are made for
the frontier alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.functions.score import (ceil_score, exponent, join_gain_sql, limb_sums, limbs_total, reported_score,
                                     stay_gain_sql)
from commune.operators.graph import Level
from commune.operators.skew import lookup
from commune.session import cache

LONG_MAX = 9223372036854775807
CONSTANTS = ("out_w", "int_n", "int_w")
CARRIED = ("cn", "ca", "ct")  # n, a and t of a message's community


def _with_degree(level: Level, assign: DataFrame) -> DataFrame:
    return assign if "deg_cnt" in assign.columns else assign.join(level.vert, "id")


def vertex_table(level: Level, assign: DataFrame) -> DataFrame:
    """``assign`` with the vertices' constants, laid out by vertex."""
    return level.lay_out(_with_degree(level, assign), "id")


def _as_senders(level: Level, rows: DataFrame) -> DataFrame:
    """``rows`` of vertices keyed and laid out like ``sym``: a hub's row stands once per salt."""
    named = rows.withColumnRenamed("id", "nbr")
    if not level.salted:
        return named if level.small else level.lay_out(named, "nbr")
    hubs = level.hubs.select(F.col("id").alias("nbr"), "salts")
    salt = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    spread = named.join(F.broadcast(hubs), "nbr", "left").withColumn("salt", salt).drop("salts")
    return level.lay_out(spread, "nbr", "salt")


def met_in_place(level: Level, senders: DataFrame) -> DataFrame:
    """(id, w) and the columns of ``senders(id, ...)``, small by the caller's proof, for each edge that they send along.

    Every edge stands in ``sym`` at its receiver too, as the row that it would send along itself: what is broadcast meets
    it there, in the layout by receiver, and no message is shuffled. Not for a level with hubs, whose rows are spread.
    """
    edges = level.sym.select(F.col("nbr").alias("id"), F.col("id").alias("sender"), "w")
    return edges.join(F.broadcast(senders.withColumnRenamed("id", "sender")), "sender").drop("sender")


def _carried(rows: DataFrame) -> list[str]:
    """The community's statistics that ``rows`` carry: all or none."""
    return [x for x in CARRIED if x in rows.columns]


def _summed(messages: DataFrame, single: bool = False) -> DataFrame:
    """Messages summed by (id, c); with ``single`` there is one for each already, and they are taken as they are."""
    if single:
        return messages.select("id", "c", F.col("w").alias("inc_w"), F.lit(1).cast("bigint").alias("k"), *_carried(messages))
    return messages.groupBy("id", "c").agg(F.sum("w").alias("inc_w"), F.count(F.lit(1)).alias("k"),
                                           *[F.max(x).alias(x) for x in _carried(messages)])


def _parts(level: Level, messages: DataFrame, single: bool = False) -> list[DataFrame]:
    """(id, c, inc_w, k), k the edges behind inc_w, of ordinary vertices laid out by vertex, and of hubs spread by (id, c)."""
    if not level.salted:
        return [_summed(level.lay_out(messages, "id"), single)]
    return [_summed(level.lay_out(messages.where(~F.col("hub")).drop("hub"), "id"), single),
            _summed(messages.where("hub"))]


def _messages(level: Level, senders: DataFrame, in_place: int | None) -> DataFrame:
    """``senders(id, deg_cnt, ...)`` sent along their edges: (id, w) and their columns, laid out by the receiver."""
    plain = senders.drop("deg_cnt")
    if in_place == 0:
        return met_in_place(level, plain)
    light = senders.where(F.col("deg_cnt") < in_place).drop("deg_cnt")
    sent = level.sym.join(level.per_vertex(_as_senders(level, light)), level.msg_keys).select("id", "w", *plain.columns[1:])
    heavy = senders.where(F.col("deg_cnt") >= in_place).drop("deg_cnt")
    return level.lay_out(sent, "id").unionByName(met_in_place(level, heavy))


def incident_parts(level: Level, assign: DataFrame, stats: DataFrame | None = None,
                   in_place: int | None = None, single: bool = False) -> list[DataFrame]:
    """Parts of (id, c, inc_w, k); with ``stats`` they carry those of ``c`` too.

    ``single``: every vertex is in a community of its own, so that ``sym`` has one row for each (id, c).
    """
    # Hash join built on the assignment side (V rows over ``partitions``): the 2E-row ``sym`` is
    # streamed from its cached layout, neither shuffled nor sorted (tests/test_scale.py).
    rows = assign if in_place is None else _with_degree(level, assign)
    senders = rows.select("id", F.col("community").alias("c"), *([] if in_place is None else ["deg_cnt"]))
    if stats is not None:
        senders = lookup(senders, _stats_by_c(stats), "c").select("id", *senders.columns[1:], *CARRIED)
    if in_place is not None:
        return [_summed(_messages(level, senders, in_place), single)]
    messages = level.sym.join(level.per_vertex(_as_senders(level, senders)), level.msg_keys)
    return _parts(level, messages.select("id", "c", "w", *_carried(senders), *(["hub"] if level.salted else [])), single)


def incident(level: Level, assign: DataFrame) -> DataFrame:
    """(id, c, inc_w): weight from vertex id to community c."""
    return reduce(DataFrame.unionByName, incident_parts(level, assign)).drop("k")


def _with_moves(part: DataFrame, sent: DataFrame, carried: list[str]) -> DataFrame:
    """``part`` after the moves in ``sent(id, prev, community, w)``: each takes an edge from one row to another."""
    def edge(c: str, sign: int) -> Column:
        return F.struct(F.col(c).alias("c"), (F.col("w") * sign).alias("inc_w"), F.lit(sign).cast("bigint").alias("k"))

    change = sent.select("id", F.inline(F.array(edge("prev", -1), edge("community", 1)))).select(
        "*", *[F.lit(None).cast("bigint").alias(x) for x in carried])
    # The changes come first: Spark sees that both are laid out by ``id`` only if the first one's ``id`` is as
    # nullable as in its layout, which a filter that it puts above a cached table changes (tests/test_kept_rows.py).
    return change.unionByName(part.select("id", "c", "inc_w", "k", *carried)).groupBy("id", "c").agg(
        F.sum("inc_w").alias("inc_w"), F.sum("k").alias("k"), *[F.max(x).alias(x) for x in carried]).where("k > 0")


def moved_parts(level: Level, state: DataFrame, parts: list[DataFrame], carry: bool = False,
                in_place: int | None = None) -> list[DataFrame]:
    """``incident_parts`` of ``state``, from those (cached) of the half-pass that led to it; only movers send messages.

    With ``carry`` they go on carrying the statistics that ``parts`` carry; rows that a move made carry none.
    """
    carried = _carried(parts[0]) if carry else []
    movers = state.where("changed").select("id", "prev", "community")
    if in_place is not None:
        movers = state.where("changed").select("id", "deg_cnt", "prev", "community")
        return [_with_moves(parts[0], _messages(level, movers, in_place), carried)]
    sent = level.sym.join(level.per_vertex(_as_senders(level, movers)), level.msg_keys).select(
        "id", "prev", "community", "w", *(["hub"] if level.salted else []))
    if not level.salted:
        return [_with_moves(parts[0], level.lay_out(sent, "id"), carried)]
    return [_with_moves(parts[0], level.lay_out(sent.where(~F.col("hub")).drop("hub"), "id"), carried),
            _with_moves(parts[1], sent.where("hub").drop("hub"), carried)]


def flag_own(inc: DataFrame, assign: DataFrame) -> DataFrame:
    """Adds ``own``: true on the row of the vertex's own community."""
    own = assign.select("id", F.col("community").alias("c"), F.lit(True).alias("own"))
    return inc.join(own.hint("shuffle_hash"), ["id", "c"], "left").withColumn("own", F.coalesce(F.col("own"), F.lit(False)))


def flagged_parts(level: Level, vertices: DataFrame, parts: list[DataFrame]) -> list[DataFrame]:
    """Each part as (id, c, inc_w, k, own, out_w, int_n, int_w); ``vertices`` is a ``vertex_table``."""
    dim = vertices.select("id", F.col("community").alias("own_c"), *CONSTANTS)
    joined = [parts[0].join(level.per_vertex(dim, laid_out=True), "id")]
    if len(parts) > 1:
        joined.append(parts[1].join(F.broadcast(dim.join(F.broadcast(level.hubs.select("id")), "id")), "id"))
    # By XOR: a filter on an equality would become a join key, for which this layout doesn't hold.
    own = F.col("c").bitwiseXOR(F.col("own_c")) == 0
    return [j.select("id", "c", "inc_w", "k", own.alias("own"), *CONSTANTS, *_carried(j)) for j in joined]


def edge_communities(level: Level, assign: DataFrame, among: DataFrame | None = None,
                     in_place: int | None = None) -> DataFrame:
    """(c, own_c, both_w): every edge once, with the communities of both its ends and its weight seen from both.

    The end with the larger id sends its community to the other one. With ``among``, small by the
    caller's proof, only edges with both ends in these communities. With ``in_place``, edges with an end of so many
    rows meet its community at their other end, and only those between two other vertices are sent.
    """
    if among is not None:
        assign = assign.join(F.broadcast(among), "community", "left_semi")
    twice = F.when(F.col("id") == F.col("nbr"), F.col("w")).otherwise(F.col("w") * 2)  # a loop's w is doubled already
    if in_place is not None:
        rows = _with_degree(level, assign).select("id", F.col("community").alias("c"), "deg_cnt")
        heavy = F.broadcast(rows.where(F.col("deg_cnt") >= in_place).drop("deg_cnt"))
        ends = level.lay_out(rows.select(F.col("id").alias("nbr"), F.col("c").alias("own_c"), "deg_cnt"), "nbr")
        met = level.sym.join(heavy, "id").join(level.per_vertex(ends, laid_out=True), "nbr").where(
            (F.col("deg_cnt") < in_place) | (F.col("nbr") <= F.col("id"))).select("c", "own_c", twice.alias("both_w"))
        if in_place == 0:
            return met
        light = rows.where(F.col("deg_cnt") < in_place).drop("deg_cnt")
        sent = level.sym.where(F.col("id") <= F.col("nbr")).join(heavy.select("id"), "id", "left_anti").join(
            level.per_vertex(_as_senders(level, light)), level.msg_keys).select("id", "c", twice.alias("both_w"))
        dim = light.withColumnRenamed("c", "own_c")
        return met.unionByName(level.lay_out(sent, "id").join(
            level.per_vertex(level.lay_out(dim, "id"), laid_out=True), "id").select("c", "own_c", "both_w"))
    senders = _as_senders(level, assign.select("id", F.col("community").alias("c")))
    sent = level.sym.where(F.col("id") <= F.col("nbr")).join(level.per_vertex(senders), level.msg_keys).select(
        "id", "c", twice.alias("both_w"), *(["hub"] if level.salted else []))
    dim = assign.select("id", F.col("community").alias("own_c"))
    cold = sent.where(~F.col("hub")).drop("hub") if level.salted else sent
    met = level.lay_out(cold, "id").join(level.per_vertex(level.lay_out(dim, "id"), laid_out=True), "id")
    if level.salted:
        hubs = F.broadcast(dim.join(F.broadcast(level.hubs.select("id")), "id"))
        met = met.unionByName(sent.where("hub").drop("hub").join(hubs, "id"))
    return met.select("c", "own_c", "both_w")


def living_communities(state: DataFrame) -> DataFrame:
    """(community, touched) of the communities that have members; ``touched``: a mover left or joined it."""
    one, none = F.lit(1), F.lit(0)
    marks = state.select("community", one.alias("alive"), F.col("changed").cast("int").alias("touched")).unionByName(
        state.where("changed").select(F.col("prev").alias("community"), none.alias("alive"), one.alias("touched")))
    return marks.groupBy("community").agg(F.max("alive").alias("alive"), F.max("touched").alias("touched")).where(
        "alive = 1").select("community", (F.col("touched") == 1).alias("touched"))


def touched_communities(state: DataFrame) -> DataFrame:
    """(community) that some mover of the half-pass behind ``state`` left or joined."""
    return state.where("changed").select(F.explode(F.array("community", "prev")).alias("community")).distinct()


def frontier(level: Level, state: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, deg_cnt) of the vertices in a touched community or next to one.

    ``touched`` is small by the caller's proof. ``sym`` is scanned in place, not shuffled.
    """
    inside = state.join(F.broadcast(touched), "community", "left_semi").select("id")
    near = level.sym.join(level.per_vertex(_as_senders(level, inside)), level.msg_keys).select("id")
    return inside.unionByName(near).distinct().join(state.select("id", "deg_cnt"), "id")


def frontier_parts(level: Level, state: DataFrame, front: DataFrame, stats: DataFrame | None = None) -> list[DataFrame]:
    """``incident_parts`` of the vertices of ``front`` alone.

    ``sym`` holds both directions, so a frontier vertex's rows are met where it is the neighbour,
    in place; what is shuffled is as large as the frontier's edges.
    """
    seen = level.sym.select("id", *level.msg_keys, "w").join(
        level.per_vertex(_as_senders(level, front.select("id"))), level.msg_keys)
    rows = seen.select(F.col("nbr").alias("id"), F.col("id").alias("sender"), "w")
    senders = state.select(F.col("id").alias("sender"), F.col("community").alias("c"), "deg_cnt")
    if stats is not None:
        senders = lookup(senders, _stats_by_c(stats), "c")
    sent = ["id", "c", "w", *_carried(senders)]
    if not level.salted:
        return _parts(level, rows.join(level.per_vertex(senders.drop("deg_cnt")), "sender").select(*sent))
    hubs = F.broadcast(level.hubs.select("id", F.lit(True).alias("hub")))
    senders = senders.withColumn("hot", F.col("deg_cnt") > level.hot_rows).drop("deg_cnt")
    messages = lookup(rows, senders, "sender").join(hubs, "id", "left")
    return _parts(level, messages.select(*sent, F.coalesce("hub", F.lit(False)).alias("hub")))


def community_stats(level: Level, assign: DataFrame, flagged: DataFrame,
                    touched: DataFrame | None = None) -> DataFrame:
    """(community, n, a, t, vol_rows, members, hot) for the communities of ``assign``.

    With ``touched``, ``flagged`` need hold only the rows of touched communities' members; the
    others keep the a and t that their members carry.
    """
    return _stats_of(level, assign, flagged.where("own").select(F.col("c").alias("community"),
                                                                F.col("inc_w").alias("inc2")), touched)


def statistics(level: Level, assign: DataFrame, touched: DataFrame | None = None,
               in_place: int | None = None) -> DataFrame:
    """``community_stats`` without messages: from each edge once, with ``touched`` from their inner edges only."""
    # By XOR, as in ``flagged_parts``.
    inner = edge_communities(level, assign, touched, in_place).where(F.col("c").bitwiseXOR(F.col("own_c")) == 0)
    return _stats_of(level, assign, inner.select(F.col("c").alias("community"), F.col("both_w").alias("inc2")), touched)


def touched_stats(level: Level, state: DataFrame, flagged: DataFrame, touched: DataFrame) -> DataFrame:
    """``community_stats`` of the communities in ``touched`` alone, small by the caller's proof."""
    own = flagged.where("own").select(F.col("c").alias("community"), F.col("inc_w").alias("inc2"))
    members, inner = (x.join(F.broadcast(touched), "community", "left_semi") for x in (state, own))
    return _stats_of(level, members, inner, None)


def patched(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` that carry statistics of ``c``, with those in ``stats`` (broadcast) in place of the carried ones."""
    new = _stats_by_c(stats).select("c", *[F.col(x).alias(f"new_{x}") for x in CARRIED])
    return rows.join(F.broadcast(new), "c", "left").select(
        *[F.coalesce(f"new_{x}", x).alias(x) if x in CARRIED else x for x in rows.columns])


def _stats_of(level: Level, assign: DataFrame, inner: DataFrame, touched: DataFrame | None) -> DataFrame:
    """Statistics from the vertices and ``inner(community, inc2)``: inner weights, seen from both ends."""
    rows = assign if "deg_cnt" in assign.columns else assign.join(level.vert, "id")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    if touched is None:
        old_a = old_t = none
    else:
        rows = rows.join(F.broadcast(touched.withColumn("anew", F.lit(True))), "community", "left")
        old_a, old_t = (F.when(F.col("anew").isNull(), F.col(x)) for x in ("a", "t"))
    per_vertex = rows.select(
        "community", F.col("int_n").alias("n_part"), F.col("int_w").alias("a_part"),
        (F.col("int_w") + F.col("out_w")).alias("t_part"), F.col("deg_cnt").alias("vol_part"),
        F.lit(1).cast("bigint").alias("m_part"), zero.alias("inc2"), old_a.alias("old_a"), old_t.alias("old_t"))
    own_rows = inner.select(
        "community", *[zero.alias(x) for x in ("n_part", "a_part", "t_part", "vol_part", "m_part")],
        "inc2", none.alias("old_a"), none.alias("old_t"))
    both = per_vertex.unionByName(own_rows)
    agg = (both.coalesce(1) if level.partitions == 1 else both).groupBy("community").agg(
        F.sum("n_part").alias("n"), F.sum("a_part").alias("a0"), F.sum("t_part").alias("t0"),
        F.sum("vol_part").alias("vol_rows"), F.sum("m_part").alias("members"), F.sum("inc2").alias("inc2"),
        F.max("old_a").alias("old_a"), F.max("old_t").alias("old_t"))
    half = F.expr("inc2 div 2")
    a, t = F.col("a0") + half, F.col("t0") - half
    if touched is not None:
        a, t = F.coalesce("old_a", a), F.coalesce("old_t", t)
    return with_hot(level, agg.select("community", "n", a.alias("a"), t.alias("t"), "vol_rows", "members"))


def with_hot(level: Level, stats: DataFrame) -> DataFrame:
    """Marks communities whose candidate rows or members exceed a partition's fair share."""
    return stats.withColumn(
        "hot", (F.col("vol_rows") > F.lit(level.hot_rows)) | (F.col("members") > F.lit(level.hot_members)))


def _stats_by_c(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("community").alias("c"), F.col("n").alias("cn"), F.col("a").alias("ca"),
                        F.col("t").alias("ct"), "hot")


def with_gains(level: Level, flagged: DataFrame, stats: DataFrame, broadcast_stats: bool) -> DataFrame:
    """(id, c, own, inc_w, gain): the join gain of every (vertex, adjacent community)."""
    joined = flagged if _carried(flagged) else lookup(flagged, _stats_by_c(stats), "c", broadcast_all=broadcast_stats)
    gain = F.expr(join_gain_sql("cn", "ca", "ct", "inc_w", "out_w", "int_n", "int_w", level.total_vertices))
    return joined.select("id", "c", "own", "inc_w", gain.alias("gain"))


def _best(level: Level, gains: DataFrame, hub: bool) -> DataFrame:
    """(id, inc_own, best_gain, best_c): largest gain of another community, then its largest id."""
    most = gains.groupBy("id").agg(F.max(F.when(~F.col("own"), F.col("gain"))).alias("best_gain"),
                                   F.max(F.when(F.col("own"), F.col("inc_w"))).alias("inc_own"))
    known = F.broadcast(most) if hub else level.per_vertex(most, laid_out=True)
    reached = ~F.col("own") & (F.col("gain") == F.col("best_gain"))
    # Other rows tell nothing more; a vertex that has no such row has nothing but nulls here, as one without messages.
    return gains.join(known, "id").where(F.col("own") | reached).groupBy("id").agg(
        F.max("inc_own").alias("inc_own"), F.max("best_gain").alias("best_gain"),
        F.max(F.when(reached, F.col("c"))).alias("best_c"))


def best_moves(level: Level, parts: list[DataFrame], stats: DataFrame,
               broadcast_stats: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Per vertex with messages (id, inc_own, best_gain, best_c), and the cached tables to release.

    ``inc_own`` is null when the vertex has no neighbour in its own community, ``best_c`` when it
    has none in another. Gains are computed twice where the statistics are broadcast or carried; where they
    come by a shuffle, they are laid out by vertex and cached.
    """
    found, cached = [], []
    for k, part in enumerate(parts):
        gains = with_gains(level, part, stats, broadcast_stats)
        if not broadcast_stats and not _carried(part):
            gains = cache(gains if k else level.lay_out(gains, "id"))
            cached.append(gains)
        found.append(_best(level, gains, hub=k > 0))
    return reduce(DataFrame.unionByName, found), cached


def settle(down: bool) -> dict[str, Column]:
    """``target`` and ``move`` from community, own_value, best_gain and best_c.

    On a positive tie the larger id wins, on another staying does. ``down`` (the first, third, ...
    half-pass) lets vertices move only to a smaller community id; otherwise only to a larger one.
    """
    community, best_c, own_value = F.col("community"), F.col("best_c"), F.col("own_value")
    own_tb = F.when(own_value > 0, community).otherwise(F.lit(LONG_MAX))
    take = best_c.isNotNull() & ((F.col("best_gain") > own_value)
                                 | ((F.col("best_gain") == own_value) & (best_c > own_tb)))
    target = F.when(take, best_c).otherwise(community)
    allowed = (community > target) if down else (community < target)
    return {"target": target, "move": take & (target != community) & allowed}


def decide(level: Level, vertices: DataFrame, parts: list[DataFrame], stats: DataFrame, down: bool,
           broadcast_stats: bool, detail: bool = False, front: DataFrame | None = None,
           patch: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The state after one half-pass, and the cached tables to release.

    State: id, community, changed, prev (the community before), the vertex's constants, n, a, t
    of ``prev``, and what the decision rests on: own_value, best_gain, best_c. With ``detail`` the
    stay gain and the best community are kept as extra columns. With ``front``, all other
    vertices keep the values that ``vertices`` carries. With ``patch``, ``stats`` are those of touched communities and
    all others are carried, by the rows of ``parts`` and by ``vertices``.
    """
    N = level.total_vertices
    if patch:
        parts = [patched(p, stats) for p in parts]
    summary, cached = best_moves(level, parts, stats, broadcast_stats)
    base = ["id", "deg_cnt", *CONSTANTS]
    kept = ["own_value", "best_gain", "best_c"] if front is not None else []
    v = vertices.select(*base, F.col("community").alias("c"), *[F.col(x).alias(f"kept_{x}") for x in kept])
    if patch:
        own = vertices.select(*base, F.col("community").alias("c"),
                              *[F.col(x).alias(f"c{x}") for x in ("n", "a", "t")])
        v = patched(own, stats)
    else:
        v = lookup(v, _stats_by_c(stats), "c", broadcast_all=broadcast_stats)
    v = v.join(level.per_vertex(summary, laid_out=True), "id", "left")
    stay = F.expr(stay_gain_sql("cn", "ca", "ct", "coalesce(inc_own, 0L)", "out_w", "int_n", "int_w", N))
    v = v.withColumn("stay", stay)
    own_value = F.when(F.col("inc_own").isNotNull(), F.greatest("stay", F.lit(0.0))).otherwise(F.col("stay"))
    value = {"own_value": own_value, "best_gain": F.col("best_gain"), "best_c": F.col("best_c")}
    if front is not None:
        known = front.select("id", F.lit(True).alias("anew"))
        v = v.join(level.per_vertex(level.lay_out(known, "id"), laid_out=True), "id", "left")
        value = {k: F.when(F.col("anew"), x).otherwise(F.col(f"kept_{k}")) for k, x in value.items()}
    v = v.select(*base, F.col("c").alias("community"), F.col("cn").alias("n"), F.col("ca").alias("a"),
                 F.col("ct").alias("t"), "stay", *[x.alias(k) for k, x in value.items()])
    rule = settle(down)
    cols = [*base, F.when(rule["move"], rule["target"]).otherwise(F.col("community")).alias("community"),
            rule["move"].alias("changed"), F.col("community").alias("prev"), "n", "a", "t", "own_value", "best_gain",
            "best_c"]
    if detail:
        cols += ["stay", rule["target"].alias("best_community")]
    return v.select(*cols), cached


def score_bounds(total_vertices: int) -> dict[str, Column]:
    """Aggregates over community statistics: the largest magnitude of a term of either score."""
    return {"score": F.max(F.abs(ceil_score(F.col("n"), F.col("a"), F.col("t"), total_vertices))),
            "reported": F.max(F.abs(reported_score(F.col("n"), F.col("a"), F.col("t"), total_vertices))),
            "communities": F.count(F.lit(1))}


def score_totals(level: Level, stats: DataFrame, bounds: dict | None = None) -> tuple[float, float]:
    """Score (denominator t) and reported score (a + t, clamped at 0) of a level, as exact sums.

    Each term is cut into three integer limbs of 30 bits below the largest term's power of two, and
    the limbs are summed as BIGINT: the totals don't depend on the order of the rows, so equal
    statistics give equal bits on any number of partitions. What lies more than 90 bits below the
    largest term is left out.
    """
    N = level.total_vertices
    if bounds is None:
        bounds = stats.agg(*[c.alias(k) for k, c in score_bounds(N).items()]).first().asDict()
    terms = {"score": ceil_score(F.col("n"), F.col("a"), F.col("t"), N),
             "reported": reported_score(F.col("n"), F.col("a"), F.col("t"), N)}
    powers = {k: exponent(bounds[k] or 0.0) for k in terms}
    row = stats.agg(*[limb.alias(f"{k}{i}") for k, term in terms.items()
                      for i, limb in enumerate(limb_sums(term, powers[k]))]).first()
    totals = [limbs_total([row[f"{k}{i}"] for i in range(3)], powers[k]) for k in terms]
    return totals[0], max(totals[1], 0.0)

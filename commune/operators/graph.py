"""Working graph of one level, built from an edge list with DataFrame operators.

* ``sym(id, nbr, w)``: every edge seen from both ends, reciprocal pairs summed, a self-loop
  counted twice. If the level has hubs it also carries ``hub`` (the receiving vertex is one) and a
  ``salt`` that splits hub neighbours over several partitions. The summed pairs are written
  once per level, a row per pair (``lo, hi, w``, half as many rows as ``sym``); the table itself is laid
  out by hash of ``nbr`` (or ``(nbr, salt)``) and cached.
  A cached layout is kept by later joins, so the message join of every half-pass streams ``sym``
  without a shuffle.
* ``vert(id, out_w, int_n, int_w, deg_cnt)``: per-vertex constants.
* ``hubs(id, salts)``: vertices with more sym rows than twice a partition's share
  (at most ``partitions / 2`` rows), used for salting and skew-safe joins; none if not ``salted``.

The input is evaluated once per level: each edge gives both of its directions, and pairs are summed
and degrees counted with map-side partial aggregation. A level's partitions follow its rows
(``level_partitions``), so a level of a dozen vertices is one task and no shuffle.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from commune.operators.skew import hot_threshold
from commune.session import broadcast_ok, cache, discard, new_table_path, remember_path, shuffle_partitions, table_path

# Smallest row count that can make a key hot: below it a graph stays unsalted. It only decides
# how rows are spread, never what is computed.
DEFAULT_HOT_FLOOR = 50_000
# Vertices with at least so many ``sym`` rows are counted, to tell how many are heavy.
DEGREE_STEPS = tuple(4 ** k for k in range(1, 13))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: ``df`` written as a table in the shared checkpoint folder, and read again.

    Not ``checkpoint()``: that hands its plan's size estimate on, a product of the sizes joined, and
    the estimate of a loop's state would get several times as many digits in each round. A
    table's size is that of its files. ``discard`` deletes it.
    """
    return _written(df, df.schema)


def materialize_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and the ``metrics`` (aggregates over its rows), gathered by the same job.

    They are collected in the job's last stage, where a repeated task counts once.
    """
    seen = Observation()
    return _written(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), df.schema), seen.get


def _written(df: DataFrame, schema: StructType) -> DataFrame:
    path = new_table_path(df.sparkSession)
    df.write.parquet(path)
    return remember_path(df.sparkSession.read.schema(schema).parquet(path), path)


def table_record(df: DataFrame) -> dict:
    """Where a table written by ``materialize`` stands and its schema, as JSON values."""
    return {"path": table_path(df), "schema": df.schema.jsonValue()}


def reopen_table(spark: SparkSession, record: dict) -> DataFrame:
    schema = StructType.fromJson(record["schema"])
    return remember_path(spark.read.schema(schema).parquet(record["path"]), record["path"])


def level_partitions(sym_rows: int, most: int, hot_floor: int = DEFAULT_HOT_FLOOR) -> int:
    """Partitions of a level: one for each ``2 * hot_floor`` rows of ``sym`` (4 MB by default), up to ``most``."""
    return max(1, min(most, -(-sym_rows // max(2 * hot_floor, 1))))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Sum the weights of parallel edges (same ordered pair)."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def vertices_from_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Each edge adds its weight to both ends (a self-loop adds it twice)."""
    ends = edges.select(F.col("src").alias("id"), "weight").unionAll(edges.select(F.col("dst").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """(lo, hi, w): the edges between two vertices summed, whatever their direction; a null end counts as the lowest."""
    forward = F.col("src").isNull() | F.coalesce(F.col("src") <= F.col("dst"), F.lit(False))
    lo, hi = F.when(forward, F.col("src")).otherwise(F.col("dst")), F.when(forward, F.col("dst")).otherwise(F.col("src"))
    return edges.select(lo.alias("lo"), hi.alias("hi"), F.col("weight").alias("w")).groupBy("lo", "hi").agg(
        F.sum("w").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, nbr, w) of ``undirected`` pairs: each from both ends, a self-loop once with twice its weight."""
    def end(a: str, b: str, w: Column) -> Column:
        return F.struct(F.col(a).alias("id"), F.col(b).alias("nbr"), w.alias("w"))

    loop = F.col("lo").eqNullSafe(F.col("hi"))
    return pairs.select(F.inline(F.when(loop, F.array(end("lo", "hi", F.col("w") * 2))).otherwise(
        F.array(end("lo", "hi", F.col("w")), end("hi", "lo", F.col("w"))))))


def symmetrize(edges: DataFrame) -> DataFrame:
    """(id, nbr, w): both directions of every edge, summed per (id, nbr). The edges are read, and shuffled, once."""
    return both_ways(undirected(edges))


def hub_ends(edges: DataFrame, partitions: int, hot_floor: int = DEFAULT_HOT_FLOOR) -> DataFrame | None:
    """(id) of the vertices at so many edge ends that they would make a task hot; None if there are none.

    They are at most ``partitions / 2`` (see ``hot_threshold``), a table with a proven bound.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"))
    seen = ends.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    hot = hot_threshold(seen["rows"] or 0, partitions, hot_floor)
    if (seen["most"] or 0) <= hot:
        return None
    return materialize(ends.where(F.col("rows") > hot).select("id").coalesce(1))


def triplets(edges: DataFrame, labels: DataFrame, partitions: int | None = None,
             hot_floor: int = DEFAULT_HOT_FLOOR) -> DataFrame:
    """Edges with the community of both ends: (src, dst, weight, src_community, dst_community).

    Every row of ``edges`` is kept, parallel ones too; one with an end that has no label is left out.

    A hub may stand at either end, or at both. Labels of hubs are broadcast, so an edge between two
    hubs meets both labels where it is read: were such a pair a third of all rows, it would not be
    shuffled. An edge with one hub is dealt by its other end, whose rows are few, in the join
    on the hub's side (that finds nothing) and by that end itself in the other join.
    """
    spark = edges.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    label = labels.select("id", F.struct("community").alias("label"))
    hubs = hub_ends(edges, partitions, hot_floor)
    if hubs is None:
        found = edges
        for end in ("src", "dst"):
            found = found.join(label.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end)
        return _labelled(found)
    hub = F.broadcast(hubs)
    hub_labels = F.broadcast(hubs.join(F.broadcast(label.join(hub, "id")), "id", "left")
                             .select("id", "label", F.lit(True).alias("hub")))
    cold = label.join(hub, "id", "left_anti")
    marked = edges
    for end in ("src", "dst"):
        marked = marked.join(hub_labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"),
                                               F.col("hub").alias(f"{end}_hub")), end, "left")
    two_hubs = F.col("src_hub").isNotNull() & F.col("dst_hub").isNotNull()
    rest = marked.where(~two_hubs)
    for end, other in (("src", "dst"), ("dst", "src")):
        # Salts of hubs and of other vertices don't meet. Not a constant for the others: Spark would take it out of
        # the join's key, and with it the hubs' salt.
        salt = F.when(F.col(f"{end}_hub").isNull(), _salt(end, partitions)).otherwise(
            _salt(other, partitions) + F.lit(partitions))
        side = cold.select(F.col("id").alias(end), _salt("id", partitions).alias("salt"), F.col("label").alias("cold_label"))
        rest = rest.withColumn("salt", salt).join(side, [end, "salt"], "left").withColumn(
            f"{end}_label", F.coalesce(f"{end}_label", "cold_label")).drop("salt", "cold_label")
    return _labelled(marked.where(two_hubs).unionByName(rest))


def _salt(vertex: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(vertex), F.lit(salts)).cast("int")


def _labelled(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src_label").isNotNull() & F.col("dst_label").isNotNull()).select(
        "src", "dst", "weight", F.col("src_label.community").alias("src_community"),
        F.col("dst_label.community").alias("dst_community"))


@dataclass(frozen=True)
class LevelCounts:
    """What is counted while a level is built; with its tables, all that it takes to open it again."""

    sym_rows: int
    vertices: int
    total_vertices: int
    largest: int  # most ``sym`` rows of one vertex
    loops: int | None = None  # self-loops; None if not counted
    heavy: list[int] | None = None  # vertices with at least ``DEGREE_STEPS`` rows; None if not counted

    def heavy_from(self, most: int) -> int | None:
        """The lowest of ``DEGREE_STEPS`` that at most so many vertices, but some, reach; None if there is none."""
        return next((d for d, n in zip(DEGREE_STEPS, self.heavy or []) if 0 < n <= most), None)


@dataclass
class Level:
    pairs: DataFrame
    sym: DataFrame
    vert: DataFrame
    hubs: DataFrame | None
    vertices: int
    sym_rows: int
    total_vertices: int
    partitions: int
    most_partitions: int
    hot_rows: int
    hot_members: int
    salted: bool
    small: bool  # a row per vertex is provably small enough to broadcast
    counts: LevelCounts

    def lay_out(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` dealt over the level's partitions by hash of ``keys``; a single one takes no shuffle."""
        return _lay_out(df, self.partitions, *keys)

    def per_vertex(self, df: DataFrame, laid_out: bool = False) -> DataFrame:
        """``df``, of at most a row per vertex (and salt), as the build side of a join.

        Broadcast where the number of vertices proves it small, else built by partition. Two tables
        that are both ``laid_out`` by the join's key need no broadcast, unless they are one
        partition each: Spark would deal those anew.
        """
        if self.small and not self.salted and (self.partitions == 1 or not laid_out):
            return F.broadcast(df)
        return df.hint("shuffle_hash")

    @property
    def msg_keys(self) -> list[str]:
        """Join keys of the message join: ``nbr`` alone unless some vertex is a hub."""
        return ["nbr", "salt"] if self.salted else ["nbr"]

    def record(self) -> dict:
        """The level's tables and counts, for ``reopen_level``."""
        return {"pairs": table_record(self.pairs), "vert": table_record(self.vert), "counts": asdict(self.counts)}

    def release(self) -> None:
        """Free the cached layout and delete the level's checkpoints."""
        discard(self.sym, self.pairs, self.hubs, self.vert)


def _lay_out(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    return df.coalesce(1) if partitions == 1 else df.repartition(partitions, *keys)


def build_level(edges: DataFrame, partitions: int, total_vertices: int | None = None,
                vertex_attrs: DataFrame | None = None, hot_floor: int = DEFAULT_HOT_FLOOR) -> Level:
    """Prepare one level from ``edges``; parallel edges are summed. ``partitions`` is the most it may have.

    ``vertex_attrs(id, out_w, int_n, int_w)`` describes hypernodes (levels >= 1); at level 0
    every vertex has int_n = 1, int_w = 0 and out_w = its weighted degree.
    """
    rows = F.sum(F.when(F.col("lo").eqNullSafe(F.col("hi")), 1).otherwise(2))
    loops = F.count_if(F.col("lo").eqNullSafe(F.col("hi")))
    pairs, seen = materialize_observed(undirected(edges), rows=rows, loops=loops)
    sym_rows, n_loops = int(seen["rows"] or 0), int(seen["loops"] or 0)
    deg = both_ways(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("deg_cnt"), F.sum("w").alias("degree"))
    if vertex_attrs is None:
        vert = deg.select("id", F.col("degree").alias("out_w"), F.lit(1).cast("bigint").alias("int_n"),
                          F.lit(0).cast("bigint").alias("int_w"), "deg_cnt")
    else:
        vert = vertex_attrs.join(deg.select("id", "deg_cnt"), "id", "left").select(
            "id", "out_w", "int_n", "int_w", F.coalesce("deg_cnt", F.lit(0).cast("bigint")).alias("deg_cnt"))
    vert, seen = materialize_observed(vert, vertices=F.count(F.lit(1)), largest=F.max("deg_cnt"),
                                      **{f"from_{d}": F.count_if(F.col("deg_cnt") >= d) for d in DEGREE_STEPS})
    n_vertices = int(seen["vertices"])
    return _open_level(pairs, vert, partitions, hot_floor, LevelCounts(
        sym_rows, n_vertices, n_vertices if total_vertices is None else total_vertices, int(seen["largest"] or 0),
        n_loops, [int(seen[f"from_{d}"]) for d in DEGREE_STEPS]))


def reopen_level(spark: SparkSession, record: dict, partitions: int, hot_floor: int = DEFAULT_HOT_FLOOR) -> Level:
    """The level that ``Level.record`` describes, from the tables it names; it may be laid out otherwise."""
    return _open_level(reopen_table(spark, record["pairs"]), reopen_table(spark, record["vert"]), partitions, hot_floor,
                       LevelCounts(**record["counts"]))


def _open_level(pairs: DataFrame, vert: DataFrame, most: int, hot_floor: int, counts: LevelCounts) -> Level:
    sym_rows, n_vertices = counts.sym_rows, counts.vertices
    P = level_partitions(sym_rows, most, hot_floor)
    hot_rows = hot_threshold(sym_rows, P, hot_floor)
    hot_members = hot_threshold(n_vertices, P, hot_floor)
    share = max(sym_rows // P, 1)
    salted = counts.largest > hot_rows
    hubs = None
    if salted:
        # A hub's rows are spread over ``salts`` partitions by a hash of the other end.
        hubs = materialize(
            vert.where(F.col("deg_cnt") > hot_rows)
            .select("id", F.ceil(F.col("deg_cnt") / F.lit(share)).cast("int").alias("salts"))
            .coalesce(1))
        sender = F.broadcast(hubs.select(F.col("id").alias("nbr"), "salts"))
        receiver = F.broadcast(hubs.select("id", F.lit(True).alias("hub")))
        sym = both_ways(pairs).join(sender, "nbr", "left").join(receiver, "id", "left").select(
            "id", "nbr", "w", F.coalesce("hub", F.lit(False)).alias("hub"),
            F.when(F.col("salts").isNull(), F.lit(0))
            .otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("salt"))
        sym = _lay_out(sym, P, "nbr", "salt")
    else:
        sym = _lay_out(both_ways(pairs), P, "nbr")
    sym = cache(sym)
    return Level(pairs=pairs, sym=sym, vert=vert, hubs=hubs, vertices=n_vertices, sym_rows=sym_rows,
                 total_vertices=counts.total_vertices, partitions=P, most_partitions=most, hot_rows=hot_rows,
                 hot_members=hot_members, salted=salted,
                 small=broadcast_ok(pairs.sparkSession, n_vertices), counts=counts)


def singleton_assignment(level: Level) -> DataFrame:
    """Every vertex in its own community."""
    return level.vert.select("id", F.col("id").alias("community"), F.lit(False).alias("changed"))


def initial_stats(level: Level) -> DataFrame:
    """Level-0 starting statistics: n = 1, a = 0, t = weighted degree (self-loops ignored)."""
    return level.vert.select(
        F.col("id").alias("community"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("a"),
        F.col("out_w").alias("t"), F.col("deg_cnt").alias("vol_rows"), F.lit(1).cast("bigint").alias("members"))

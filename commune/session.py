"""Session helpers: a local session for tests and benches, and the checkpoint folder.

On a cluster the checkpoint folder is the shared one named by ``spark.checkpoint.dir`` (or by
the job's ``--checkpoint-dir``); a folder of our own is chosen only for local masters whose
session has none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CACHE_ENCODED = "spark.sql.inMemoryColumnarStorage.compressed"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "commune") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Return the reliable checkpoint folder: ``folder``, the session's own, or (local masters) a new one."""
    sc = spark.sparkContext
    if folder:
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir (or pass a checkpoint folder): "
                             f"executors of {sc.master} don't share a folder of this machine")
        configured = tempfile.mkdtemp(prefix="commune-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def new_table_path(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def remember_path(df: DataFrame, path: str) -> DataFrame:
    """Mark ``df`` as the reader of a table that ``discard`` may delete."""
    df._commune_table = path
    return df


def table_path(df: DataFrame) -> str:
    return vars(df)["_commune_table"]


def discard(*frames: DataFrame | None) -> None:
    """Release cached tables and delete the files of those that ``frames`` read.

    Only for tables that nothing refers to any more: a plan over a deleted table fails.
    """
    for df in frames:
        if df is None:
            continue
        df.unpersist()
        path = vars(df).get("_commune_table")
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def cache(df: DataFrame) -> DataFrame:
    """``df`` cached in memory and on disk, its columns not encoded one by one.

    Finding the best encoding of every column takes longer than the work on rows that have a few readers only. Blocks are
    compressed as a whole where ``spark.rdd.compress`` says so, as it does in PySpark's sessions by default. The setting is
    the session's again afterwards: Spark reads it when a table is marked as cached.
    """
    conf = df.sparkSession.conf
    before = conf.get(CACHE_ENCODED)
    conf.set(CACHE_ENCODED, "false")
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(CACHE_ENCODED, before)


def broadcast_ok(spark: SparkSession, rows_bound: int, row_bytes: int = 64, least_limit: int = 0) -> bool:
    """True when a table of at most so many rows is provably small enough; results don't depend on it.

    The limit is Spark's own for broadcasts, or ``least_limit`` if that is more and broadcasts aren't switched off.
    """
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return limit > 0 and max(limit, least_limit) >= rows_bound * row_bytes


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

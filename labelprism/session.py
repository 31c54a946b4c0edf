"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session used by this library should carry.  AQE coalesces the
# small post-shuffle partitions of label-level aggregates and splits skewed join
# partitions (one label or one term may hold a third of all rows).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "labelprism",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)


def share_code(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package from where the
    driver has it.  On a cluster the package comes with ``--py-files`` or is
    installed, and the path does nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; we only invent one for a local-mode session (tests,
    bench), never on a cluster where a machine-local folder would be lost with
    the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running lineage-cutting operators")
    path = tempfile.mkdtemp(prefix="labelprism-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made and run inside have the files of their shuffles removed when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed; the files that its shuffles wrote are removed at once, not
    when the driver next happens to collect its garbage."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` read back from Parquet in the checkpoint folder; its shuffles' files are removed."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.select("*").write.parquet(folder)
    return spark.read.parquet(folder)


def kept(rdd: RDD) -> RDD:
    """``rdd`` checkpointed; its rows are found once."""
    rdd = rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    rdd.count()
    rdd.unpersist()
    return rdd


def release_shuffles(rdd: RDD) -> None:
    """Remove the files of the shuffles that ``rdd`` comes from, up to what is kept:
    for rows that nobody reads again."""
    rdd._jrdd.rdd().cleanShuffleDependencies(True)


def forget(rows: RDD | DataFrame) -> None:
    """Rows that nobody reads again: out of memory, and their checkpoint's files removed."""
    rows.unpersist()
    if isinstance(rows, RDD):
        written = [rows.getCheckpointFile()] if rows.getCheckpointFile() else []
        spark = SparkSession.active()
    else:
        spark = rows.sparkSession
        found = rows._jdf.queryExecution().analyzed()
        rdd = found.rdd() if found.nodeName() == "LogicalRDD" or found.getClass().getSimpleName() == "LogicalRDD" else None
        file = rdd.getCheckpointFile() if rdd is not None else None
        written = [file.get()] if file is not None and file.isDefined() else []
    for name in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

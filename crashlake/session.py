"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "crashlake") -> SparkSession:
    """A local session with the settings the triage plans expect (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (`spark.checkpoint.dir`).

    On a cluster the folder is set by the deployment and only read here.  When
    it is unset (local tests) a fresh folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
    path = tempfile.mkdtemp(prefix="crashlake-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_held: list = []
_folders: list[list[str]] = [[], []]


def hold(df):
    """Keep the rows of `df` (memory, then disk) once a query first computes them.

    For a table that several branches of one plan read.  A lost executor's part
    is computed again.  `let_go` and `release` drop it; a plan whose tables are
    dropped stays right and computes them anew.
    """
    from pyspark import StorageLevel

    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(held)
    return held


def let_go() -> None:
    """Unpersist what is held."""
    while _held:
        df = _held.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist(blocking=False)


def materialize(df, name: str):
    """`df` as Parquet in the shared checkpoint folder, read back: later plans read the columns they need and start from files.

    What the plan holds is dropped once it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    let_go()
    _folders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Drop held tables, and the files of the triage before the last one; called when a triage query is built."""
    let_go()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in _folders.pop(0):
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _folders.append([])

"""Session helpers: a local session for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "panelwright") -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own."""
    cpus = str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the checkpoint folder and read it back.

    Compared with a row checkpoint the table keeps column pruning and filter pushdown, its size is
    known to the planner, and the plan runs exactly once. It survives the loss of any executor.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch at most where rows are whole texts: some 10 MB of usual documents.
TEXT_ROWS = 2000


def prepare_text_jobs(spark: SparkSession) -> None:
    """Share the package with the workers, and keep Arrow batches of whole texts small on both sides."""
    share_package(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= TEXT_ROWS:
        spark.conf.set(setting, str(TEXT_ROWS))


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this host import the package from where the driver did; clusters ship it with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast a narrow table whose rows were counted; beyond `max_rows` leave the join to Spark.

    The count stops at the limit and nothing is written: a table that turns out large costs one partial evaluation.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

"""Sessions: the settings the engine is meant to run with."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """A session that iterative operators can checkpoint in: the folder that the cluster names, or one of our own on a local master.
    Elsewhere a folder must be set: executors of a cluster don't see the driver's disk."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="geolith-checkpoint-"))
    return spark


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder. For loops: what the next round reads carries no plan, statistics or
    constraints of the rounds before, which a checkpointed frame does, and which grow with each."""
    spark = prepared(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, tile: str = "tile") -> DataFrame:
    """df with each tile's rows in one partition, tiles spread over more partitions than there are cores. For work that takes far longer than
    its bytes tell: shuffles that Spark may coalesce would bring all tiles to one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, tile)


def beside(job: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """Begins a job that runs while the caller goes on -> a function that waits for what it gives. For a long task beside others that leave cores free."""
    pool = ThreadPoolExecutor(1)
    found = pool.submit(job)
    pool.shutdown(wait=False)
    return found.result


def drop(df: DataFrame) -> None:
    """Delete a table that `written` gave, once nothing reads it any more. Shuffles of jobs that have ended are kept as long as the driver's
    collector hasn't seen that their plans are gone; it is told to look, so that a long chain of steps holds the disk of one."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as the tests and the benchmark use it."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("geolith").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepared(spark)

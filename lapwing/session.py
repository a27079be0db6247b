"""Session helpers: runtime settings, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Join on the championship key alone when both sides already sit on it, and let
# the adaptive planner split a skewed join partition even at the cost of one
# more exchange.  A written table can be fifty times smaller than its rows in memory: what isn't tiny as a file
# is broadcast only once the adaptive planner has measured it.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.fileCompressionFactor": "20",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "lapwing") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("LAPWING_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    shared = shared or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="lapwing-")
    return _LOCAL_DIRS[app]


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lapwing-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application has left in the shared folder; tables that were read from there are gone with it."""
    drop_folder(spark, scratch_dir(spark))


def folder_of(df: DataFrame) -> str | None:
    """The folder that ``cut_lineage`` has written a table into, as long as the table isn't cached."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, partitions: Sequence[str] = ()) -> DataFrame:
    """Writes a table into the shared folder, by ``partitions`` if any, and reads it back.

    Later jobs start from files, so a lost executor costs only its own tasks, and
    each reader scans just the columns it needs.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

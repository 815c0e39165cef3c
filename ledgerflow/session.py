"""Session helpers: a local session for tests and durable lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "ledgerflow", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage cuts go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``; a temporary
    one is made only in local runs and tests, where that setting is absent.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerflow-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_run = threading.local()


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table under the checkpoint folder, inside the running step's own if there is one."""
    base = getattr(_run, "folder", None) or ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediate tables of a step that writes its results itself; it goes at the end of the step."""
    outer = getattr(_run, "folder", None)
    _run.folder = scratch_table(spark, "run")
    try:
        yield _run.folder
    finally:
        path, _run.folder = _run.folder, outer
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, name: str = "cut", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Unlike a local checkpoint this survives the loss of executors, and the plan
    that follows starts from plain files with known sizes. Like checkpoint data,
    the table is left to the folder's own retention. ``rows_per_file`` cuts the
    files, so that costly work on few bytes is dealt to all cores without a shuffle.
    """
    path = scratch_table(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

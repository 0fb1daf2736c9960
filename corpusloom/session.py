"""Session helpers shared by every subpackage.

``shared_dir`` is where lineage is cut.  On a cluster it is the folder that
``spark.checkpoint.dir`` names; only a purely local session may fall back to a
temporary folder, because there driver and executors are one process.
"""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Progress of iterated fits, at level INFO.
log = logging.getLogger("corpusloom")

_LOCAL: dict[str, str] = {}


def get_spark(app: str = "corpusloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, examples and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts lineage so that a lost executor costs a re-read, not a re-run of
    everything upstream, and it makes row counts and sizes cheap to check.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that ``materialize`` returned."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return int(total)

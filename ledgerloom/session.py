"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Nothing here fixes a partition count for the cluster: AQE starts from a generous
# number of shuffle partitions and coalesces them to the advisory size at run time.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_OWN: dict[str, str] = {}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A local session for tests and the bench, with a checkpoint folder of its own; on a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    if SparkSession.getActiveSession() is None:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        builder = builder.config("spark.checkpoint.dir", folder).config("spark.ledgerloom.local.dir", folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session that is one process gets a folder of
    its own; with executors elsewhere this raises, as it does for a folder that was made for one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local["):  # one process: any folder is shared
        path = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="ledgerloom-")
        _OWN[spark.sparkContext.applicationId] = path
    if not path:
        raise ValueError("spark.checkpoint.dir is unset; name a folder that the driver and all executors share")
    if path == spark.conf.get("spark.ledgerloom.local.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{path} belongs to one machine; spark.checkpoint.dir must name a shared folder")
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, cutting its lineage.

    Unlike a cached frame the table survives the loss of executors.
    """
    target = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, for code that runs there."""
    if spark.conf.get("ledgerloom.shipped", "") != spark.sparkContext.applicationId:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-zip-"), "ledgerloom")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
        spark.conf.set("ledgerloom.shipped", spark.sparkContext.applicationId)

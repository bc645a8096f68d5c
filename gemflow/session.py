"""Session defaults, table reading and durable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gemflow")
    settings = _DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a temporary folder serves, but only with a local master:
    on a cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_gemflow_shared", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="gemflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.sparkContext._gemflow_shared = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, under the name of the application."""
    return f"{shared_dir(spark)}/gemflow/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate results of this application.

    DataFrames that queries gave read them, so this is for after the last of those was written or collected.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gemflow/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cores_of(spark: SparkSession) -> int:
    """Task slots to spread Python-heavy work over, at least the shuffle partitions."""
    return max(int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per session, wherever the driver was started."""
    if getattr(spark.sparkContext, "_gemflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gemflow-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "gemflow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._gemflow_shipped = True

"""Session, shared storage and package shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "corvane", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster, pass your own session instead."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of `spark`, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("corvane") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._corvane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of this machine only where that is unset in a local session."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corvane-shared-")
        sc.setCheckpointDir(at)
    return at


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage is cut, sizes are known to the planner,
    and the table survives the loss of executors. The files go when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Remove staged tables that nothing will read again; other tables are left alone."""
    for df in tables:
        if (path := getattr(df, "_corvane_path", None)) is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str | None = None) -> str:
    """A path of this driver in the shared folder, new unless named; what lies there goes when the driver ends."""
    folder = f"{shared_dir(spark)}/corvane-{os.getpid()}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{name or uuid.uuid4().hex}"


_folders: set[str] = set()


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _folders:
        return
    _folders.add(folder)

    def remove() -> None:
        try:
            _delete(spark, folder)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

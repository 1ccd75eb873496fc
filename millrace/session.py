"""Session helpers shared by every module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own and this is not used there."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a private one only where none is named and all run in one
    process (tests). A cluster without a named folder is an error: its executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage and survives lost executors.

    The table stays until `removed` takes it or the folder goes: what is read from it may be computed long after.
    """
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"millrace-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/millrace-" in path:
                p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that it need not be installed on them.

    The archive lies in the shared folder where the session names one on a file system, else beside the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = shared_dir(spark)
    folder = folder[5:] if folder.startswith("file:") else folder
    if "://" in folder:
        folder = tempfile.mkdtemp(prefix="millrace-")
    elif folder.startswith("//"):
        folder = folder[2:]
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, f"millrace-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the application, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="voxframe-")) / "voxframe.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, os.fspath(p.relative_to(here.parent)))
    sc.addPyFile(os.fspath(target))
    _SHIPPED.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster; only where neither the setting nor the context has one (local tests) is a
    temporary folder used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxframe-"))
    return named or sc.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/voxframe-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone already: whoever owns the folder clears it
        pass


def release(spark: SparkSession) -> None:
    """Delete what this application keeps in the shared folder; results that were not written elsewhere can no longer be read."""
    _remove(spark, _own_folder(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place for a query's own file in the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def shared_table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a compressed table in the shared folder and read them from there.

    A lost executor loses nothing of it, and later stages read only the columns they need.
    """
    place = scratch(df.sparkSession, "rows.parquet")
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)

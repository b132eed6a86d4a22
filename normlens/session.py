"""Session helpers: one builder for tests and benches, and table access by scale-factor folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "normlens", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session in instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    A local session without that setting gets a temporary folder, which goes with the process; a cluster's session has to
    name one. (The setting itself cannot be changed while a session runs.)"""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="normlens-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_folders[app] = "file://" + folder
        where = _own_folders[app]
    return where.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system, if the session still runs."""
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path, as Spark would read it: with its scheme, also where the path names none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    return "file:///" + found[5:].lstrip("/") if found.startswith("file:") else found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

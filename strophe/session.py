"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; sizes themselves are left to the cluster and to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "strophe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a context, where PYTHONPATH doesn't."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_strophe", False):
        return
    at = Path(tempfile.mkdtemp(prefix="strophe-")) / "strophe.zip"  # the driver's file server hands it out
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._strophe = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: shuffled only if its scan has fewer splits, as a small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local runs only) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        if path.startswith(("/", "file:/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


#: With this setting the shuffle files of a query are removed when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder, with options of the writer, and read it back.

    Cuts the lineage and keeps a result that several branches use from being
    computed again; it survives the loss of executors. The shuffle files it took
    go once it is written. Removed by `unstage`, else when the driver ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/strophe-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._strophe = path, atexit.register(partial(_remove, spark, path))
    return out


def unstage(*staged: DataFrame) -> None:
    """Remove tables that `stage` wrote and nothing will read again."""
    for df in staged:
        path, at_exit = df._strophe
        _remove(df.sparkSession, path)
        atexit.unregister(at_exit)

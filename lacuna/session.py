"""SparkSession helpers.

Cluster settings (shuffle partitions, checkpoint dir, AQE) come from the
session the caller hands in; ``local_session`` is only for tests and bench
runs on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "lacuna") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="lacuna-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    ``spark.checkpoint.dir`` of the session wins; else the folder set with
    ``SparkContext.setCheckpointDir``. Only a plain local master (one machine:
    tests, bench) may fall back to a scratch folder; anywhere else a
    machine-local folder would lose data, so this raises.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = sc.getCheckpointDir()
        if not current:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="lacuna-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def materialize(df, name: str = "t"):
    """Cut lineage by writing a parquet table into the shared ``spark.checkpoint.dir``.

    One job writes the table; reading it back gives Catalyst/AQE real size
    statistics (so small results are broadcast and big ones are not). A lost
    executor re-reads the files instead of re-running the upstream plan.
    Used for reused intermediates: the order cube and the gold index.
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system (works for any shared store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rename_files(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Give the files of a folder another ending (a metadata operation per file)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.endswith(old):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f.getPath().getParent(), name[: -len(old)] + new))


def input_state(spark: SparkSession, folder: str) -> tuple:
    """(file, length, modification time) of the tables in a folder: changes when a table is rewritten."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lacuna`` importable in Python workers (once per application).

    The per-partition scans (``mapInPandas``) run in Python workers, which
    import this package; it is zipped on the driver and distributed with
    ``SparkContext.addPyFile`` (the standard way PySpark ships code), so the
    jobs work whatever the workers' working directory or installed packages.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="lacuna-pyfiles-"), "lacuna.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)

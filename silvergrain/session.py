"""Session helpers: local session for tests, and durable lineage cuts."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Folders of lineage cuts that have not been released.
_CUTS: list[str] = []
#: Spark's setting to delete the shuffle files of an execution at its end, not at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", app: str = "silvergrain") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Query settings every plan relies on.

    Timestamps are text in UTC. Wide score projections can outgrow the size the
    JVM still compiles; above this limit Spark splits them into small methods.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's own setting wins.

    Only a local-mode session without a setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="silvergrain-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from that table.

    A written table survives lost executors, and later reads prune its columns
    and know its size, so joins against small results can be broadcast safely.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    known = spark.conf.isModifiable(CLEANUP)
    before = spark.conf.get(CLEANUP) if known else None
    if known:
        spark.conf.set(CLEANUP, "true")  # what is shuffled for the table is read by nothing else
    try:
        df.write.parquet(path)
    finally:
        if known:
            spark.conf.set(CLEANUP, before)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_cuts() -> None:
    """Deletes the tables written by :func:`cut_lineage` so far; call it when their results have been written."""
    while _CUTS:
        drop_folder(_CUTS.pop())


def drop_cut(cut: DataFrame) -> None:
    """Deletes the table of one cut as soon as nothing reads it any more."""
    for folder in {os.path.dirname(file) for file in cut.inputFiles()}:
        drop_folder(folder)


def drop_folder(path: str) -> None:
    """Deletes a folder of this library's own, in any store that Arrow reaches."""
    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        store.delete_dir(inner)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_silvergrain_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="silvergrain-py-"), "silvergrain.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._silvergrain_shipped = True

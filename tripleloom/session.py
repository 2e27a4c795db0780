"""Session helpers: partition counts and shared scratch tables.

Iterative operators cut lineage by writing a table to the folder the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so it survives the loss of any of them).
A folder of our own is made only where that setting is absent and everything runs on this machine.
Loops drop the tables of rounds that nothing reads any more; the rest goes when the application ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []
_used: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session: a worker need not find it on its own path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tripleloom-code-")  # the driver serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(name)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tripleloom-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return "file://" + _own_root[0]


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear(spark: SparkSession, folder: str) -> None:
    try:
        delete_folder(spark, folder)
    except Exception:  # noqa: BLE001  the session has gone before us
        pass


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new name below the shared folder; what is written there goes when the application ends."""
    folder = f"{scratch_root(spark)}/tripleloom/{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}-{label}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage beyond its files."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            delete_folder(t.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

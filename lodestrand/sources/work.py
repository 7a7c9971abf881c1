"""Shared working folder: where lineage is cut so that a lost executor costs a re-read, not a re-run.

Nothing here keeps data on one executor only. The folder is the one the session names in
``spark.checkpoint.dir``; only where that is unset and driver and executors are one process (local tests) a temporary one is chosen.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_paths: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediate tables; a cluster has to name one, a local session is given one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrand-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; what is written there goes when the driver's Python ends."""
    path = f"{work_dir(spark)}/lodestrand/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean)
    _paths.append(path)
    return path


def _clean() -> None:
    """Delete what this driver left in a mounted shared folder; other file systems need a lifetime rule of their own."""
    for path in _paths:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: later plans start from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has far fewer partitions, as a single small file has; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for clusters that do not have it installed."""
    from pathlib import Path

    key = spark.sparkContext.applicationId
    if key not in _shipped:
        _shipped.add(key)
        root = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="lodestrand-zip-")) / "lodestrand_package"
        spark.sparkContext.addPyFile(shutil.make_archive(str(name), "zip", root.parent, root.name))

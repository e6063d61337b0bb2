"""Session settings that the engine's plans expect."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "quartermill", **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` has dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once, if they may not find it.

    Workers find a package that PYTHONPATH names, or that was submitted with
    --py-files. Where neither is so, Spark's file server hands out an archive.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_quartermill_shipped", False):
        return
    sc._quartermill_shipped = True
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in named or root.suffix == ".zip" or any("quartermill" in x for x in sc.getConf().get("spark.submit.pyFiles", "").split(",")):
        return
    to = Path(tempfile.mkdtemp()) / "quartermill.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "quartermill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(to))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the setting is absent and Spark runs on this machine alone
    (tests) a temporary folder takes its place; a cluster must name one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quartermill-"))
        found = sc.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder once and cuts its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()

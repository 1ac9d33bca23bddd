"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quarryline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a machine-local folder would be lost with its machine, so that case is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of data that is no longer read, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_within(df: DataFrame, max_rows: int, otherwise: str = "") -> DataFrame:
    """Hint a broadcast only when a (materialised) side is counted to be small enough.

    Above ``max_rows`` the side is returned as it is, or with the hint ``otherwise``: "merge" where the
    other side is exploded, which Spark takes to be as small as before and may broadcast.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package where it is not on their path.

    Nothing to do if the path is in PYTHONPATH, which workers inherit, or is where they start.
    Otherwise the package goes out as a zip file with the job, once for a session.
    """
    spark = spark or SparkSession.active()
    home = str(PACKAGE.parent)
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if home in known or os.path.realpath(os.getcwd()) == home or getattr(context, "_quarryline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quarryline-package-")
    archive = shutil.make_archive(f"{folder}/quarryline", "zip", root_dir=home, base_dir=PACKAGE.name)
    context.addPyFile(archive)
    context._quarryline_shipped = True

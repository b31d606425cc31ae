"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE; everything else stays with the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where lineage is cut: the folder the caller has set, or the one the cluster names in ``spark.checkpoint.dir``.

    Only where both are unset, and on one machine, as in tests, a temporary folder is
    chosen; it goes when the driver ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        if not named:
            named = tempfile.mkdtemp(prefix="ledgerlens-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for a table that later steps read and correct."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, whose Python need not have it on its path; once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_ledgerlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="ledgerlens-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "ledgerlens.zip")  # read by the driver, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(Path(package.name) / file.relative_to(package)))
    context.addPyFile(archive)
    context._ledgerlens_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a table in the shared folder. Plans then know its size, where a checkpoint keeps the estimate of its plan, which a loop of joins multiplies every round."""
    folder = table_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

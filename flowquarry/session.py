"""Session settings, the shared checkpoint folder, and shipping of the package to workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app_name: str = "flowquarry", master: str | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with the package on its workers. ``checkpoint_dir`` has to be a folder that all executors share."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's modules to the workers once per application, so that jobs run from any folder."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        _SHIPPED.add(application)
        top = os.path.dirname(os.path.abspath(__file__))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            for folder, _, files in os.walk(top):
                for name in files:
                    if name.endswith(".py"):
                        place = os.path.join(folder, name)
                        archive.write(place, os.path.relpath(place, os.path.dirname(top)))
        path = os.path.join(tempfile.mkdtemp(prefix="flowquarry-package-"), "flowquarry.zip")
        with open(path, "wb") as file:
            file.write(data.getvalue())
        spark.sparkContext.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor can reach: ``spark.checkpoint.dir`` of the session, else one in its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays the whole history."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables handed from one job to the next."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Removes a table of ``scratch_path`` that nothing reads any more, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def store_scratch(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared folder and read again: evaluated once, readable column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

"""Session defaults and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR_CONF = "spark.checkpoint.dir"
# Methods above 8000 bytes are never compiled by the JVM; long projections run faster as smaller pieces.
CODEGEN = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app_name: str = "partloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the adaptive features the operators count on.

    Broadcasts are left to Spark's own size checks (``autoBroadcastJoinThreshold`` before and after AQE
    statistics); hot join keys are split by the AQE skew join.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **CODEGEN,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without one (tests, a laptop) gets a temporary folder; on a cluster that would be a folder
    of one machine, so it is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR_CONF, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(CHECKPOINT_DIR_CONF)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set(CHECKPOINT_DIR_CONF, folder)
    return folder


def tune(spark: SparkSession) -> SparkSession:
    """Settings of a session built elsewhere that matter for the long projections here."""
    for key, value in CODEGEN.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path below the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder and return the table.

    Survives the loss of executors, unlike a local checkpoint, and gives the reader exact sizes. ``group_rows`` is for rows
    of megabytes: the writer holds up to 100 of them in a page, and the reader up to 4096 of a row group, however large.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    for open_list in _made:
        open_list.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables ``written`` inside the block when it ends; its results must be stored by then."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield
    finally:
        _made.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

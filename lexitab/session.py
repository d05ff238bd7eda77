"""Session settings the plans in this package rely on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC and ANSI are part of the semantics; the rest lets AQE size and split partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go once no plan reads them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "lexitab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied tables, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. Where it is unset, one of our own in local mode and an error on a cluster."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexitab-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


@contextmanager
def scratch(spark: SparkSession):
    """A new folder that all executors see, removed at the end: what is read from it must be written elsewhere by then (see written_once())."""
    folder = f"{shared_folder(spark)}/sources/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_once(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: for plans that read a costly table several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

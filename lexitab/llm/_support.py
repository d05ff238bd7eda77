"""What the operators of this subpackage share: shipping code, checkpoints, name-safe columns."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitab.session import shared_folder

#: Bytes of one Arrow batch sent to Python; whole texts can be long, so rows alone don't bound memory.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that have no copy of it, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_lexitab_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp())
    root = Path(folder, "src")
    shutil.copytree(package, root / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", root))
    shutil.rmtree(root)
    context._lexitab_shipped = True


#: The shared folder named by spark.checkpoint.dir; the library has it in one place.
checkpoint_dir = shared_folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    kept = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return _noted(out, kept.get() if kept.isDefined() else None)


def write_table(df: DataFrame, path: str, group_bytes: int | None = None) -> None:
    """Writes df as Parquet, in row groups of about group_bytes if given; its shuffle files go once it is written, not only when the driver next collects garbage.

    The setting for that is read where a query starts. It is on while any thread writes through here, and then as it was before.
    """
    conf = df.sparkSession.conf
    with _setting:
        if not _writing:
            _before[:] = [conf.get(_CLEAN, None)]
            conf.set(_CLEAN, "true")
        _writing.append(path)
    try:
        writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
        writer.parquet(path)
    finally:
        with _setting:
            _writing.remove(path)
            if not _writing:
                conf.unset(_CLEAN) if _before[0] is None else conf.set(_CLEAN, _before[0])


#: Spark's own setting, what is being written, the setting before that, and who may change these.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: list[str] = []
_before: list[str | None] = []
_setting = threading.Lock()


def cut_columnar(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Like cut(), as compressed Parquet beside the checkpoints: smaller for wide intermediate tables. group_bytes bounds row groups of rows with long lists."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    write_table(df, path, group_bytes)
    return _noted(spark.read.schema(df.schema).parquet(path), path)


#: Paths that cut() and cut_columnar() have written within the workspace() of this thread; None outside of one.
_noting: ContextVar[set[str] | None] = ContextVar("_noting", default=None)


def _noted(df: DataFrame, path: str | None) -> DataFrame:
    df._lexitab_path = path
    if path and _noting.get() is not None:
        _noting.get().add(path)
    return df


@contextmanager
def workspace(spark: SparkSession):
    """Removes at its end what cut() and cut_columnar() have written in it, and nothing that another thread or workspace has.

    For callers that write what they read from those tables before the end, as the pipeline does in each stage. Outside of a
    workspace an operator leaves the tables that its result still reads; checkpoints among them go with the last plan that reads
    them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    mine: set[str] = set()
    token = _noting.set(mine)
    try:
        yield mine
    finally:
        _noting.reset(token)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Removes tables of cut() and cut_columnar() once all that was read from them is written too."""
    for table in tables:
        path = getattr(table, "_lexitab_path", None)
        if path:
            table._lexitab_path = None
            if _noting.get() is not None:
                _noting.get().discard(path)
            remove(table.sparkSession, path)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names for internal use that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_parts(column: pa.Array | pa.ChunkedArray):
    """(bytes or None) of each string of an Arrow column, without decoding."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        yield from chunk.cast(pa.large_binary()).to_pylist()


#: The operator whose tables this worker holds, and what frees them. Workers are reused from stage to stage.
_holding: list[tuple[str, Callable[[], None]]] = []


def hold(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Called where a worker starts on an operator's rows: frees what another operator has left in the worker."""
    if _holding and _holding[0][0] == owner:
        return
    if _holding:
        _holding.pop()[1]()
        pa.default_memory_pool().release_unused()
    _holding.append((owner, release))


def arrow_column(owner: str, function: Callable, kind: str, release: Callable[[], None] = lambda: None):
    """A function of Arrow arrays as a column function that is evaluated once, however often its result is used.

    Marked as not deterministic, as the optimiser otherwise copies it into filters that it infers from joins.
    """

    def run(*columns: pa.Array) -> pa.Array:
        hold(owner, release)
        return function(*columns)

    return F.arrow_udf(run, kind).asNondeterministic()

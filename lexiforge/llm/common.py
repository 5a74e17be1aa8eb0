"""What the operators share: tables written to the cluster's shared folder, and files in it.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs at most the tasks of the running stage.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one if there is one machine only (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="lexiforge-"))
        folder = _own_folder[0]
    # with its scheme, so that executors' own file systems find it too
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/lexiforge")
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            drop_path(spark, path)


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and return the table read from there.

    The shuffle files of the write go as soon as it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiforge_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        path = getattr(t, "_lexiforge_path", None)
        if path:
            drop_path(t.sparkSession, path)


@contextlib.contextmanager
def scope():
    """Inside, everything that new_path() names is a step's own; at the end it is deleted, but for the tables of materialize() that are put into the list it gives."""
    mark, kept = len(_written), []
    yield kept
    paths = {getattr(t, "_lexiforge_path", None) for t in kept}
    for spark, path in _written[mark:]:
        if path not in paths:
            drop_path(spark, path)
    _written[mark:] = [(spark, path) for spark, path in _written[mark:] if path in paths]


#: Hadoop's names of file systems that Arrow knows by other names.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """(file system, path in it) of a URI, on any machine of the cluster. A DBFS path is read through its mount."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def tidy(run):
    """A map function over Arrow batches that gives memory back to the system when its task ends: workers live on, and idle ones would keep it."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def make_folder(uri: str) -> None:
    filesystem_, path = filesystem(uri)
    filesystem_.create_dir(path, recursive=True)


def task_file(folder: str, part: int, suffix: str) -> str:
    """A name that no other attempt of the task uses; only the names that finished tasks report are ever read."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def quoted(name: str):
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

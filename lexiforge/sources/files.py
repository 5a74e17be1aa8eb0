"""A sink that writes named files, one for each name, by a commit protocol.

Rows (file, value) arrive sorted by file, every file whole in one task. A task writes below the job's own temporary folder, under a name that no other attempt
uses, and reports what it wrote; the driver moves the reported files to their names when all tasks have ended well, and removes the temporary folder
in any case. So a killed or repeated attempt leaves nothing, and an earlier file stays until its successor is complete.
A null value adds nothing, but makes the file.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "lexiforge_files"


def located(location: str):
    """(Arrow's file system, path) of a location: a URI whose path is not percent-encoded, or a local path."""
    from pyarrow import fs

    m = re.fullmatch(r"([A-Za-z][\w+.-]*):(//[^/]*)?(/.*)", location, re.S)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else location
    system, base = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(m[1], m[1]) }:{m[2] or '//'}/")
    return system, base.rstrip("/") + m[3]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (temporary location, file)."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.temporary = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        files: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not files or files[-1][1] != name:
                        if out:
                            out.close()
                        files.append((f"{self.temporary}/{uuid.uuid4().hex}", name))
                        system, path = located(files[-1][0])
                        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(path)
                    if value is not None:
                        out.write(value.encode())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.clear()
            raise ValueError(f"rows of one file in several places: {sorted({n for n in names if names.count(n) > 1})[:3]}")
        for temporary, name in files:
            system, path = located(name)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            if system.get_file_info(path).is_file:
                system.delete_file(path)
            system.move(located(temporary)[1], path)
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        system, path = located(self.temporary)
        if system.get_file_info(path).type.name == "Directory":
            system.delete_dir(path)


class Files(DataSource):
    """Option folder: where the temporary folder is made, on the file system of the files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["folder"])


def qualified(spark, folder: str) -> str:
    """A folder with its scheme, for tasks on any machine."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_files(rows: DataFrame, folder: str, *order: str) -> None:
    """file, value of rows as the files of these names, values in the order of the columns `order`. folder: see Files."""
    spark = rows.sparkSession
    spark.dataSource.register(Files)
    sorted_ = rows.repartition("file").sortWithinPartitions("file", *order)
    sorted_.select("file", F.col("value").cast("string").alias("value")).write.format(FORMAT).option("folder", qualified(spark, folder)).mode("append").save()


def below(folder: str, docs: DataFrame) -> tuple[str, int]:
    """(folder with its scheme, length of the common folder of the paths `doc` of docs): what comes after that many characters names a file below the folder."""
    low, high = docs.agg(F.min("doc"), F.max("doc")).first()
    n = 0
    if low is not None:
        # what the least and the greatest path share, all share
        while n < len(low) and low[n] == high[n]:
            n += 1
        n = low.rfind("/", 0, n) + 1
    return qualified(docs.sparkSession, folder), n

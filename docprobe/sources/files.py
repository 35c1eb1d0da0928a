"""A folder of files written by executors: one file a row, by a data source with commit and abort.

A task writes each file under a temporary name and then renames it to its own, inside a hidden folder beside the target; so a retried
or speculative task replaces its twin's file and leaves no second copy. The job's commit renames the hidden folder to the target in one
step, its abort deletes it (a task that is still running then finds no folder to write to): readers see all files or none. Files are opened by pyarrow's file systems, so the folder must lie in one that
those know (local or mounted, hdfs, and the object stores), and commit is as atomic as a rename there. ``file_names`` lists such a folder by tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docprobe.sources.scratch import shuffles_deleted, stored

NAME, CONTENT = "name", "content"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    files: int
    bytes: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)


class FileTreeWriter(DataSourceArrowWriter):
    """Writes rows (name, content) under ``path``; ``overwrite`` replaces what is there, otherwise a target that exists is an error."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        folder, _, last = self.path.rpartition("/")
        self.stage = f"{folder}/_{last}-{uuid.uuid4().hex}"
        fs, stage = opened(self.stage)
        for part in ("", "/files", "/open"):
            fs.create_dir(f"{stage}{part}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Names are relative paths, each in one row; contents of null make empty files."""
        fs, stage = opened(self.stage)
        task, files, size, folders = TaskContext.get(), 0, 0, {""}
        attempt = f"{stage}/open/{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex}"
        fs.create_dir(attempt, recursive=False)
        for batch in batches:
            for name, content in zip(batch.column(NAME), batch.column(CONTENT)):
                target = _checked(name.as_py())
                parts = target.split("/")[:-1]
                for folder in ("/".join(parts[: k + 1]) for k in range(len(parts))):
                    if folder not in folders:
                        fs.create_dir(f"{stage}/files/{folder}", recursive=False)  # never makes the hidden folder anew
                        folders.add(folder)
                data = content.as_buffer() if content.is_valid else b""
                with fs.open_output_stream(f"{attempt}/file") as out:
                    out.write(data)
                fs.move(f"{attempt}/file", f"{stage}/files/{target}")
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, stage = opened(self.stage)
        target = opened(self.path)[1]
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            if not self.overwrite:
                fs.delete_dir(stage)
                raise FileExistsError(f"{self.path} exists")
            fs.delete_dir(target)
        fs.move(f"{stage}/files", target)
        fs.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        fs, stage = opened(self.stage)
        if fs.get_file_info(stage).type != pafs.FileType.NotFound:
            fs.delete_dir(stage)


def _checked(name: str | None) -> str:
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a file's name below the target: {name!r}")
    return name


class FileTree(DataSource):
    """The format ``docprobe-files``."""

    @classmethod
    def name(cls) -> str:
        return "docprobe-files"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, name: str = NAME, content: str = CONTENT, overwrite: bool = False) -> None:
    """One file a row of ``df``, by its executors. Rows move through no shuffle; two rows of one name leave one file."""
    df.sparkSession.dataSource.register(FileTree)
    rows = df.select(df[name].cast("string").alias(NAME), df[content].cast("binary").alias(CONTENT))
    with shuffles_deleted(df.sparkSession):
        rows.write.format(FileTree.name()).mode("overwrite" if overwrite else "append").save(path)


def delete_folder(path: str) -> None:
    """A folder of few files, a scratch table, goes."""
    fs, at = opened(path.rstrip("/"))
    fs.delete_dir(at)


def delete_files(spark: SparkSession, path: str) -> None:
    """A folder of many files goes: tasks delete its files, so that no single process has to delete them all."""
    path = path.rstrip("/")

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(path)
        for batch in batches:
            for name in batch.column(NAME).to_pylist():
                try:
                    fs.delete_file(f"{top}/{name}")
                except FileNotFoundError:  # by a task that is tried again
                    pass
        yield from ()

    names = file_names(spark, path).select(NAME).repartition(4 * spark.sparkContext.defaultParallelism, NAME)
    names.mapInArrow(gone, f"{NAME} string").write.format("noop").mode("overwrite").save()
    delete_folder(path)


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """name (below ``path``), length: the files of a folder and of all folders in it, but for hidden ones (``_`` or ``.`` first).

    Each folder is listed by a task, level by level; names of folders reach the driver, those of files do not.
    """
    path = path.rstrip("/")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(path)
        for folder in (f for batch in batches for f in batch.column(NAME).to_pylist()):
            found = [i for i in fs.get_file_info(pafs.FileSelector(f"{top}/{folder}".rstrip("/"))) if i.base_name[0] not in "_."]
            for part in (found[a : a + 10_000] for a in range(0, len(found), 10_000)):
                names = [f"{folder}/{i.base_name}".lstrip("/") for i in part]
                yield pa.RecordBatch.from_pydict({NAME: pa.array(names, pa.string()), "length": pa.array([None if i.type == pafs.FileType.Directory else i.size for i in part], pa.int64())})

    levels, folders = [], [""]
    while folders:
        given = spark.createDataFrame([(f,) for f in folders], f"{NAME} string").repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
        levels.append(stored(given.mapInArrow(listed, f"{NAME} string, length bigint"), "listed"))
        folders = [f for (f,) in levels[-1].where("length is null").select(NAME).collect()]
    return reduce(DataFrame.union, levels).where(F.col("length").isNotNull())

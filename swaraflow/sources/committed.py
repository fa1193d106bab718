"""Files that appear together or not at all: a Python data source whose rows are files.

Rows are ``path`` (below the target folder) and ``content``.  Every attempt of a task
writes to a folder of its own beside the target; the driver, once all tasks have
succeeded, gathers the files of the attempts that Spark committed in a new folder and
puts that in the target's place by a rename.  A failed job removes what it wrote and
leaves the target as it was.  Readers of the target see the old files or the new ones.

This is for tens to thousands of files such as manifests, audio and reports: each
costs a rename on the driver.  Tables belong in Parquet.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed_files"


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _exists(store, path: str) -> bool:
    from pyarrow.fs import FileType

    return store.get_file_info(path).type != FileType.NotFound


def put(path: str, text: str) -> None:
    """Writes one small document from the driver to any store that Arrow opens; it appears whole."""
    store, at = _store(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    new = f"{at}.new-{uuid.uuid4().hex}"
    with store.open_output_stream(new, compression=None) as out:
        out.write(text.encode())
    store.move(new, at)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: list[str]


class Writer(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"
        store, base = _store(self.staging)
        store.create_dir(base, recursive=True)  # once, on the driver: tasks of a job that was given up find it gone

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, base = _store(self.staging)
        attempt, files = uuid.uuid4().hex, []
        store.create_dir(f"{base}/{attempt}", recursive=False)
        for row in iterator:
            name = posixpath.normpath(row["path"])
            if name.startswith(("/", "..")):
                raise ValueError(f"{row['path']} isn't below the target")
            at = f"{base}/{attempt}/{name}"
            if not _exists(store, base):
                raise RuntimeError("the job was given up")
            store.create_dir(posixpath.dirname(at), recursive=True)
            with store.open_output_stream(at, compression=None) as out:
                out.write(bytes(row["content"] or b""))
            files.append(name)
        return Attempt(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.staging)
        _, target = _store(self.target)
        names = [(m.folder, f) for m in messages if m is not None for f in m.files]
        if len({f for _, f in names}) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same path")
        whole = f"{base}/whole"
        store.create_dir(whole, recursive=True)
        for folder, name in names:
            store.create_dir(posixpath.dirname(f"{whole}/{name}"), recursive=True)
            store.move(f"{base}/{folder}/{name}", f"{whole}/{name}")
        old = f"{base}/old"
        if _exists(store, target):
            store.move(target, old)
        try:
            store.move(whole, target)
        except OSError:
            if _exists(store, old):
                store.move(old, target)
            raise
        store.delete_dir(base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.staging)
        if _exists(store, base):
            store.delete_dir(base)


class CommittedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        target = self.options["path"]
        store, at = _store(target)
        if _exists(store, at) and not overwrite:
            raise ValueError(f"{target} is there already")
        return Writer(target, overwrite)


def publish(files: DataFrame, path: str, overwrite: bool = False, source: type[CommittedFiles] = CommittedFiles) -> None:
    """Writes ``path, content`` rows as the files of a new folder, or in place of one."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(source)
    files.select("path", "content").write.format(source.name()).mode("overwrite" if overwrite else "append").option("path", path).save()

"""One file for each row, as a sink with a commit: a folder is replaced as a whole, or stays as it was."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "textloom_files"


@dataclass
class Written(WriterCommitMessage):
    """What a task says of its files."""

    files: int
    size: int


def _beside(root: str, kind: str) -> tuple[str, str]:
    """The folder that holds ``root``, and how the names of its neighbours of a kind begin."""
    parent, _, name = root.rstrip("/").rpartition("/")
    return parent or "/", f".{name}.{kind}-"


class FilesWriter(DataSourceArrowWriter):
    """Rows (file, text) to files below a staging folder beside the target, which takes the target's place once all tasks are done.

    A task that runs again writes the same files; each is moved to its name when it is complete. If the job fails, staging goes. If the driver dies between the two
    moves of a commit, the old folder waits beside the target, and the next writer puts it back.
    """

    def __init__(self, path: str):
        self.path = path
        fs, root = pafs.FileSystem.from_uri(path)
        parent, begin = _beside(root, "staging")
        self.staging = f"{parent.rstrip('/')}/{begin}{uuid.uuid4().hex}"
        self._put_back(fs, root)

    def _put_back(self, fs: pafs.FileSystem, root: str) -> None:
        parent, begin = _beside(root, "old")
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            return
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(parent, allow_not_found=True)) if i.base_name.startswith(begin)]
        if len(old) == 1:
            fs.move(old[0], root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        made, files, size = set(), 0, 0
        now = part = out = None

        def done():
            if out is not None:
                out.close()
                fs.move(part, f"{self.staging}/{now}")

        try:
            for batch in iterator:
                texts = batch.column("text").cast(pa.binary())
                for file, body in zip(batch.column("file").to_pylist(), texts, strict=True):
                    if file != now:
                        done()
                        now, files = file, files + 1
                        at = f"{self.staging}/{file}"
                        folder = at.rpartition("/")[0]
                        if folder not in made:
                            fs.create_dir(folder, recursive=True)
                            made.add(folder)
                        part = f"{at}.{uuid.uuid4().hex}.part"
                        out = fs.open_output_stream(part)
                    body = body.as_py() or b""
                    out.write(body)
                    size += len(body)
            done()
            out = None
        finally:
            if out is not None and not out.closed:
                out.close()
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(self.staging, recursive=True)  # without rows no task has
        parent, begin = _beside(root, "old")
        old = None
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            old = f"{parent.rstrip('/')}/{begin}{uuid.uuid4().hex}"
            fs.move(root, old)
        fs.move(self.staging, root)
        if old:
            fs.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


class Files(DataSource):
    """``df.write.format("textloom_files").mode("overwrite").save(path)`` for rows (file, text); names are relative to the path and lie inside it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if not overwrite:
            raise ValueError("this sink replaces its folder: use mode('overwrite')")
        if sorted(schema.names) != ["file", "text"]:
            raise ValueError("rows must be (file, text)")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    from textloom.session import ship

    ship(spark)
    spark.dataSource.register(Files)


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (file, text) to a file each; rows of one name follow each other in one task and are its pieces."""
    register(rows.sparkSession)
    rows.select("file", "text").write.format(FORMAT).mode("overwrite").save(path)

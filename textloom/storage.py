"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders of local applications without the setting, which can't be set later.
_own: dict[str, str] = {}
_noted: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="textloom-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _noted:
        made.append(path)
    return path


def mounted(spark: SparkSession, label: str) -> str | None:
    """A new path below the shared folder as programs open it; nothing where that isn't mounted."""
    if (path := shared_dir(spark)) and "://" in path and not path.startswith("file://"):
        return None
    return new_path(spark, label).removeprefix("file://").removeprefix("file:")


def discard(*paths: str) -> None:
    """Deletes folders below the shared one that nothing reads any more; those that are gone already are ignored."""
    for path in paths:
        fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)


@contextmanager
def scratch():
    """What is written inside goes at the end, but for the paths that are taken off the list. The results must have been written by then, as Spark reads late."""
    made: list[str] = []
    _noted.append(made)
    try:
        yield made
    finally:
        _noted[:] = [x for x in _noted if x is not made]
        discard(*made)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``stored_at`` of the result is the folder.

    It cuts the lineage: a lost executor costs only the tasks that were running. Columns become nullable.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out

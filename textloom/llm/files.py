"""Binary files in a folder that all executors share, through the file systems pyarrow knows."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def write(uri: str, data: bytes) -> None:
    """Whole or not at all: a task that is run again puts the same bytes under the same name."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(f.size() - start if size is None else size)


def mapped(uri: str) -> pa.Buffer:
    """The whole of a file; where the folder is mounted, by the page cache that all workers of a machine share, else in memory."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def size(uri: str) -> int:
    fs, path = _open(uri)
    return fs.get_file_info(path).size


def there(uri: str) -> bool:
    fs, path = _open(uri)
    return fs.get_file_info(path).type == pafs.FileType.File

"""Files in the shared folder, written and read by tasks through the file system that their address names.

A task writes under a name of its own and returns it; only names that come back from successful tasks are ever read,
so a lost executor or a second attempt leaves at most a file that nobody refers to.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs as pafs


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def writing(uri: str) -> BinaryIO:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def reading(uri: str):
    """A file with read_at-like random access: seek, read, size."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise OSError(f"{length} bytes at {offset} asked for, {len(data)} there")
    return data

"""Files of tasks in the shared folder, by any file system that pyarrow opens."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def fresh_name(stem: str, suffix: str) -> str:
    """A name of its own for every task attempt: only the files that a finished
    attempt reports count, so retries and speculative copies do no harm."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def mapped(uri: str, name: str) -> pa.NativeFile:
    """Random access to a shared file, memory-mapped where the folder is mounted."""
    fs, path = pafs.FileSystem.from_uri(uri)
    full = f"{path}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(full)
    return fs.open_input_file(full)

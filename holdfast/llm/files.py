"""Raw files in the shared folder, read and written by tasks.

A task writes under a name of its own and returns it as a row. Only names in the saved manifest
count, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A new file under a folder; knows its offset."""

    def __init__(self, folder: str, prefix: str, suffix: str):
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.offset = 0

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        return at, len(data)

    def close(self) -> None:
        self.stream.close()


class Reader:
    """Range reads from the files of a folder; one file stays open at a time."""

    def __init__(self, folder: str):
        self.system, self.path = open_fs(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise OSError(f"{name}: {length} bytes wanted at {offset}, {len(data)} found")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


@contextmanager
def reading(folder: str) -> Iterator[Reader]:
    reader = Reader(folder)
    try:
        yield reader
    finally:
        reader.close()

"""Files that executors write and read themselves, by Arrow file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given by URI or path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class NewFile:
    """A file written under a name no other attempt of the task uses.

    A task that fails leaves at most an unnamed part: readers open only what a
    finished task reports.
    """

    def __init__(self, folder: str, suffix: str):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        self.out = self.fs.open_output_stream(self.path)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Appends; returns where it begins."""
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> str:
        self.out.close()
        return self.path


class RangeReader:
    """Reads byte ranges of a file."""

    def __init__(self, folder: str, path: str):
        self.file = open_folder(folder)[0].open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()

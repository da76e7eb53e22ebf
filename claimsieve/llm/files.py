"""Files that tasks write and read in the shared folder, through whichever file system its address names."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class AtomicFile:
    """A file that appears under its name only when it is whole.  A repeated task writes the same bytes again and
    replaces the file, so a lost executor or a second attempt leaves one valid file."""

    def __init__(self, uri: str):
        self.store, self.path = open_store(uri)
        folder = self.path.rpartition("/")[0]
        self.store.create_dir(folder, recursive=True)
        self.hidden = f"{folder}/.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.hidden)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append and return the offset at which ``data`` starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.store.move(self.hidden, self.path)


def read_range(handle, start: int, size: int) -> bytes:
    handle.seek(start)
    return handle.read(size)

"""Binary files of tasks, through pyarrow's file systems, under a folder all machines share.

A task writes files under names of its own attempt and reports them in a manifest; only
rows of tasks that ended well reach the manifest, so what a lost executor left is ignored.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str):
    """(file system, path) of a URI or plain path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Rolling:
    """Files of about ``size`` bytes under ``root``: ``write`` bytes that stay together.

    ``closed(path, length)`` is called with each finished file.
    """

    def __init__(self, root: str, suffix: str, size: int, head: bytes = b""):
        self.fs, self.base = opened(root)
        self.fs.create_dir(self.base, recursive=True)
        self.suffix, self.size, self.head = suffix, size, head
        self.out, self.path, self.at = None, None, 0

    def begin(self) -> None:
        self.path = f"{self.base}/{uuid.uuid4().hex}{self.suffix}"
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(self.head)
        self.at = len(self.head)

    def write(self, data: bytes) -> int:
        """Append; the offset at which the data begin."""
        if self.out is None:
            self.begin()
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.size

    def close(self) -> str | None:
        """End the present file and return its path."""
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return self.path

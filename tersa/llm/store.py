"""Files in the shared folder, which may be a local path, file: or a store that pyarrow knows (hdfs:, s3:, gs:, abfs:)."""

from __future__ import annotations

import re

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Ranges:
    """Range reads, with the last few files kept open."""

    def __init__(self, most: int = 8):
        self.most, self.open = most, {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = place(uri)
            self.open[uri] = system.open_input_file(path)
        f = self.open[uri]
        f.seek(offset)
        data = f.read(length)
        if len(data) != length:
            raise OSError(f"{uri}: {len(data)} of {length} bytes at {offset}")
        return data

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()

"""Files that tasks write and range-read themselves, on any file system a URI names."""

from __future__ import annotations

from collections import OrderedDict

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path there; ``file:/x``, as Hadoop writes it, is a local path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class RangeReader:
    """Reads byte ranges; keeps the last few files open."""

    def __init__(self, most_open: int = 16):
        self.most_open = most_open
        self.files: OrderedDict[str, object] = OrderedDict()

    def __call__(self, uri: str, offset: int, length: int) -> bytes:
        file = self.files.pop(uri, None)
        if file is None:
            system, path = locate(uri)
            file = system.open_input_file(path)
            while len(self.files) >= self.most_open:
                self.files.popitem(last=False)[1].close()
        self.files[uri] = file
        return file.read_at(length, offset)

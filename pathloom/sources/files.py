"""Files that executors read in parts: by path or URI, with ranged reads."""

from __future__ import annotations

import pyarrow.fs as pafs


def split_uri(path: str):
    """(file system, path in it) of a local path or of a URI that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return pafs.LocalFileSystem(), path


class Ranged:
    """A file as a sequence of bytes: a slice reads only what it covers. The last
    block read is kept, so that headers of many small fields are a few reads."""

    BLOCK = 1 << 16

    def __init__(self, path: str):
        system, place = split_uri(path)
        self._file = system.open_input_file(place)
        self._size = self._file.size()
        self._from, self._held = 0, b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self._size)
        if hi <= lo:
            return b""
        if not self._from <= lo <= hi <= self._from + len(self._held):
            self._file.seek(lo)
            self._from, self._held = lo, self._file.read(max(hi - lo, min(self.BLOCK, self._size - lo)))
        return self._held[lo - self._from : hi - self._from]

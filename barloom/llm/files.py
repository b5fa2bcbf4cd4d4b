"""Binary files on shared storage, written and read by tasks.

A task writes under a name of its own attempt and reports it in a row; only rows of the attempts
that Spark accepted reach the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a local one."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Writer:
    """A file of one task attempt."""

    def __init__(self, folder: str, suffix: str) -> None:
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        self.name = f"{uuid4().hex}{suffix}"
        self._out = files.open_output_stream(f"{root}/{self.name}", compression=None)
        self.length = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which the data begin."""
        at = self.length
        self._out.write(data)
        self.length += len(data)
        return at

    def close(self) -> None:
        self._out.close()


def read_ranges(
    folder: str, ranges: Iterable[tuple[str, int, int]], gap: int, most: int
) -> Iterator[bytes]:
    """The bytes of each ``(name, offset, length)``, which come sorted by name and offset.

    Neighbours at most ``gap`` bytes apart are fetched together, up to ``most`` bytes at once.
    """
    files, root = opened(folder)
    source, current = None, None

    def fetch(group: list[tuple[str, int, int]]) -> Iterator[bytes]:
        begin = group[0][1]
        end = max(offset + length for _, offset, length in group)
        data = memoryview(source.read_at(end - begin, begin))
        for _, offset, length in group:
            yield bytes(data[offset - begin : offset - begin + length])

    group: list[tuple[str, int, int]] = []
    try:
        for name, offset, length in ranges:
            if group and (
                name != current
                or offset - (group[-1][1] + group[-1][2]) > gap
                or offset + length - group[0][1] > most
            ):
                yield from fetch(group)
                group = []
            if name != current:
                if source is not None:
                    source.close()
                source, current = files.open_input_file(f"{root}/{name}"), name
            group.append((name, offset, length))
        if group:
            yield from fetch(group)
    finally:
        if source is not None:
            source.close()

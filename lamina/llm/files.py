"""Byte files in the shared folder, written and range-read by tasks through their URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def create(folder: str, prefix: str, suffix: str):
    """A new output stream with a name no other task attempt uses; returns (uri, stream)."""
    uri = f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def coalesced(ranges: Iterable[tuple], gap: int = 64 << 10, most: int = 4 << 20) -> Iterator[tuple[int, int, list]]:
    """Merge (offset, length, key) sorted by offset into (start, end, members) where gaps are small."""
    start = end = 0
    members: list = []
    for offset, length, key in ranges:
        if members and (offset - end > gap or offset + length - start > most):
            yield start, end, members
            members = []
        if not members:
            start, end = offset, offset
        members.append((offset, length, key))
        end = max(end, offset + length)
    if members:
        yield start, end, members


class Reader:
    """Keeps the last file open; rows arrive sorted by file and offset."""

    def __init__(self):
        self.uri, self.handle = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = fs.FileSystem.from_uri(uri)
            self.uri, self.handle = uri, system.open_input_file(path)
        return self.handle.read_at(length, offset)

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.uri, self.handle = None, None

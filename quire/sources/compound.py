"""Compound files: the streams of a container made of sectors, read by ranges.

A file is a header, sectors, and an allocation table that chains them (itself spread over sectors
that the header and further chained sectors list).  Short streams lie in small sectors of one
long stream.  The directory is a stream too: a tree of storages and streams.  Every chain and the
tree may be damaged; nothing is followed twice, and what is wrong with one stream is known for
that stream alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Fixed values of the format: marks in tables, sizes, kinds of entries.
FREE, END, TABLE, FURTHER = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
HEADER, ENTRY, FIRST_TABLES, NONE = 512, 128, 109, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5


class Damaged(ValueError):
    """The file or one of its chains is not as it must be."""


class Compound:
    """A compound file over anything that seeks and reads; only what is asked for is read."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.bytes = file, size
        head = self._range(0, HEADER)
        if head[:8] != MAGIC:
            raise Damaged("not a compound file")
        shift, small_shift = struct.unpack_from("<HH", head, 30)
        if shift not in (9, 12) or small_shift >= shift:
            raise Damaged(f"sector sizes of 2^{shift} and 2^{small_shift} bytes")
        self.version = struct.unpack_from("<H", head, 26)[0]
        self.size, self.small = 1 << shift, 1 << small_shift
        self.sectors = max(0, -(-size // self.size) - 1)
        directory, _, self.cutoff, small_table, _, further = struct.unpack_from("<6I", head, 48)
        listed = [s for s in struct.unpack_from(f"<{FIRST_TABLES}I", head, 76) if s < FURTHER]
        seen: set[int] = set()
        while further < FURTHER:
            if further in seen or len(seen) > self.sectors:
                raise Damaged("the list of table sectors runs in a circle")
            seen.add(further)
            *more, further = struct.unpack(f"<{self.size // 4}I", self._sector(further))
            listed += [s for s in more if s < FURTHER]
        self.table = [x for s in listed for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.directory = self._entries(b"".join(self._chained(directory, self.table, "directory")))
        root = self.directory[0] if self.directory else None
        if root is None or root["kind"] != ROOT:
            raise Damaged("no root entry")
        # What holds the short streams is looked at when one of them is asked for.
        self._small_start, self._small_table, self._root = small_table, None, root

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) < n and at + n <= self.bytes:
            raise Damaged(f"bytes {at} to {at + n} cannot be read")
        return data

    def _sector(self, number: int, n: int = 1) -> bytes:
        """`n` sectors from this one on; the file's last may be cut short."""
        if number + n > self.sectors:
            raise Damaged(f"sector {number + n - 1} lies behind the end")
        data = self._range((number + 1) * self.size, n * self.size)
        return data.ljust(n * self.size, b"\0")

    def _chain(self, start: int, table: list[int], what: str) -> Iterator[tuple[int, int]]:
        """(first sector, number) of the runs of neighbouring sectors of a chain."""
        first, n, at, seen = start, 0, start, bytearray(len(table))
        while at < FURTHER:
            if at >= len(table):
                raise Damaged(f"{what}: sector {at} is in no table")
            if seen[at]:
                raise Damaged(f"{what}: its sectors run in a circle")
            seen[at] = 1
            n += 1
            after = table[at]
            if after != at + 1:
                yield first, n
                first, n = after, 0
            at = after
        if at != END:
            raise Damaged(f"{what}: its chain ends in {at:#x}")

    def _chained(self, start: int, table: list[int], what: str) -> Iterator[bytes]:
        for first, n in self._chain(start, table, what):
            yield self._sector(first, n)

    def _entries(self, raw: bytes) -> list[dict]:
        out = []
        for at in range(0, len(raw) - ENTRY + 1, ENTRY):
            length, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<3I", raw, at + 68)
            start, size = struct.unpack_from("<IQ", raw, at + 116)
            name = raw[at : at + min(max(length - 2, 0), 62)].decode("utf-16-le", errors="replace")
            out.append({"name": name, "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size if self.version > 3 else size & 0xFFFFFFFF})
        return out

    def streams(self) -> list[tuple[str, dict]]:
        """(path, entry) of all streams, paths with slashes, in their order in the tree."""
        out, seen = [], {0}
        stack = [("", self._root["child"])]
        while stack:
            above, number = stack.pop()
            if number == NONE:
                continue
            if number in seen or number >= len(self.directory):
                raise Damaged("the directory's tree runs in a circle" if number in seen else f"no directory entry {number}")
            seen.add(number)
            entry = self.directory[number]
            path = above + entry["name"]
            if entry["kind"] == STREAM:
                out.append((path, entry))
            stack += [(above, entry["right"]), (above, entry["left"])]
            if entry["kind"] == STORAGE:
                stack.append((path + "/", entry["child"]))
        return sorted(out, key=lambda x: x[0])

    def chunks(self, path: str, entry: dict) -> Iterator[bytes]:
        """The bytes of a stream, run by run."""
        left = entry["size"]
        if not left:
            return
        if left > self.bytes:
            raise Damaged(f"{path}: {left} bytes in a file of {self.bytes}")
        source = self._chained(entry["start"], self.table, path) if left >= self.cutoff else self._short(path, entry)
        for data in source:
            yield data[:left]
            left -= min(left, len(data))
            if not left:
                return
        raise Damaged(f"{path}: {left} bytes are missing")

    def read(self, path: str, entry: dict) -> bytes:
        return b"".join(self.chunks(path, entry))

    def _short(self, path: str, entry: dict) -> Iterator[bytes]:
        if self._small_table is None:
            raw = b"".join(self._chained(self._small_start, self.table, "table of short streams"))
            self._holder = list(self._chain(self._root["start"], self.table, "holder of short streams"))
            self._small_table = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        for first, n in self._chain(entry["start"], self._small_table, path):
            yield from self._held(first * self.small, n * self.small)

    def _held(self, at: int, n: int) -> Iterator[bytes]:
        """A range of the stream that holds the short ones."""
        for first, count in self._holder:
            length = count * self.size
            if at < length and n:
                part = min(n, length - at)
                lo, hi = at // self.size, -(-(at + part) // self.size)
                yield self._sector(first + lo, hi - lo)[at - lo * self.size :][:part]
                at, n = at + part, n - part
            at = max(0, at - length) if at >= length else 0
        if n:
            raise Damaged("a short stream lies behind its holder")

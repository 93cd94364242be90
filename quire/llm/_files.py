"""Files in the shared folder, read and written by tasks through its file system."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """(file system, path) of a URI; anything that pyarrow reaches, a mounted folder included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Commit:
    """A file that appears under its name only when it is whole.

    It is written under a temporary name of this attempt and renamed at the end; attempts of
    one task write the same bytes, so whichever renames last changes nothing.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = open_fs(folder)
        self.final = f"{base}/{name}"
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(base, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)

    def abort(self) -> None:
        """Drops the temporary file of an attempt that failed."""
        if not self.stream.closed:
            self.stream.close()
            self.fs.delete_file(self.temporary)

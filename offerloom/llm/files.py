"""Binary files in the shared folder, written by tasks under a temporary name and renamed."""

from __future__ import annotations

import contextlib
import mmap
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse


class FileSet:
    """A folder by URI: file paths directly, other schemes through pyarrow's file systems (HDFS, S3, GCS)."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root = unquote(parsed.path)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextlib.contextmanager
    def writing(self, name: str) -> Iterator:
        temporary = self._at(f".{name}.{uuid.uuid4().hex}")
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(temporary, "wb", buffering=1 << 20) as out:
                yield out
            os.replace(temporary, self._at(name))
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(temporary) as out:
                yield out
            self.fs.move(temporary, self._at(name))

    @contextlib.contextmanager
    def mapped(self, name: str) -> Iterator:
        """The file's bytes, memory-mapped where the file system allows it."""
        if self.local:
            with open(self._at(name), "rb") as f:
                if os.fstat(f.fileno()).st_size == 0:
                    yield b""
                    return
                held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                try:
                    yield held
                finally:
                    with contextlib.suppress(BufferError):  # a view still in use keeps the map
                        held.close()
        else:
            with self.fs.open_input_file(self._at(name)) as f:
                yield f.read_buffer()

    @contextlib.contextmanager
    def reading(self, name: str) -> Iterator:
        if self.local:
            with open(self._at(name), "rb", buffering=1 << 20) as f:
                yield f
        else:
            with self.fs.open_input_stream(self._at(name)) as f:
                yield f

    def remove(self, name: str) -> None:
        if self.local:
            os.unlink(self._at(name))
        else:
            self.fs.delete_file(self._at(name))

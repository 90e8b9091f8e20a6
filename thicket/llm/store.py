"""Raw arrays in the shared folder: written whole by tasks, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


class Store:
    """Files of one folder, given by its address. In a folder that the machine can open, files are mapped
    where they are; from any other store a file is copied to one without a name, which goes with the
    mapping. A file appears under its name only when it is complete, so tasks may be run again."""

    def __init__(self, address: str):
        self.address = address.rstrip("/")
        at = urlparse(self.address)
        self.path = unquote(at.path) if at.scheme in ("", "file") else None
        self._maps: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"address": self.address, "path": self.path, "_maps": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.address)

    def write(self, name: str, array: np.ndarray) -> None:
        data = memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b""
        part = f"{name}.{uuid.uuid4().hex}"
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{part}", "wb") as out:
                out.write(data)
            os.replace(f"{self.path}/{part}", f"{self.path}/{name}")
            return
        files, root = self._remote()
        with files.open_output_stream(f"{root}/{part}") as out:
            out.write(data)
        files.move(f"{root}/{part}", f"{root}/{name}")

    def read(self, name: str, kind: type) -> np.ndarray:
        """The file as an array, mapped once for the life of this object."""
        if name not in self._maps:
            if self.path is not None:
                source = open(f"{self.path}/{name}", "rb")  # noqa: SIM115  the mapping outlives it
            else:
                files, root = self._remote()
                source = tempfile.TemporaryFile()  # noqa: SIM115
                with files.open_input_stream(f"{root}/{name}") as data:
                    while part := data.read(1 << 22):
                        source.write(part)
                source.flush()
            with source:
                size = os.fstat(source.fileno()).st_size
                mapped = mmap.mmap(source.fileno(), size, access=mmap.ACCESS_READ) if size else b""
            self._maps[name] = np.frombuffer(mapped, kind)
        return self._maps[name]

"""Files in the shared folder, written and read by range from any task, wherever the folder is."""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
import zstandard
from pyarrow import fs


class Folder:
    """A folder named by a URI or a local path.

    New files have names of their own, so a task that runs again never writes over what another attempt wrote; only
    files whose names were returned are read. A file with a given name is written aside and moved into place, so
    attempts that write the same contents don't meet half of it.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self._opened: dict = {}

    def __getstate__(self):
        return self.uri

    def __setstate__(self, uri):
        self.__init__(uri)

    @property
    def place(self):
        if "fs" not in self._opened:
            self._opened["fs"] = fs.FileSystem.from_uri(self.uri) if ":" in self.uri else (fs.LocalFileSystem(), self.uri)
        return self._opened["fs"]

    def child(self, name: str) -> Folder:
        return Folder(f"{self.uri.rstrip('/')}/{name}")

    def path(self, name: str) -> str:
        return f"{self.place[1].rstrip('/')}/{name}"

    def create(self, suffix: str):
        """The name of a new file and a stream that writes it."""
        name = uuid.uuid4().hex + suffix
        system, path = self.place
        system.create_dir(path, recursive=True)
        return name, system.open_output_stream(self.path(name), compression=None)

    def write(self, suffix: str, raw: bytes) -> str:
        """The name of a new file that holds the bytes."""
        name, stream = self.create(suffix)
        with stream:
            stream.write(raw)
        return name

    def put(self, name: str, raw: bytes) -> None:
        """Writes a file of that name."""
        aside = self.write(".part", raw)
        self.place[0].move(self.path(aside), self.path(name))

    def has(self, name: str) -> bool:
        return self.place[0].get_file_info(self.path(name)).type == fs.FileType.File

    def file(self, name: str):
        return self.place[0].open_input_file(self.path(name))

    def read(self, name: str, offset: int, length: int) -> bytes:
        with self.file(name) as f:
            return f.read_at(length, offset)

    def whole(self, name: str):
        """A file's bytes, memory-mapped where the folder is local."""
        if self.place[0].type_name == "local":
            with open(self.path(name), "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with self.file(name) as f:
            return f.read()

    def delete(self, name: str) -> None:
        """Deletes a file if it is there."""
        try:
            self.place[0].delete_file(self.path(name))
        except FileNotFoundError:
            pass

    def remove(self) -> None:
        """Deletes the folder and all that is in it, if it is there."""
        try:
            self.place[0].delete_dir(self.place[1])
        except FileNotFoundError:
            pass


def layout(arrays: dict[str, np.ndarray], notes: dict | None = None) -> bytes:
    """Arrays one after another as they are in memory, behind a header, so that a mapped file can be read in place."""
    places, at = {}, 0
    for k, v in arrays.items():
        places[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 8) * 8
    head = json.dumps({"places": places, "notes": notes or {}}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *(v.tobytes() + bytes(-v.nbytes % 8) for v in arrays.values())])


def laid_out(raw) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays and notes of :func:`layout`, over the bytes themselves."""
    size = int.from_bytes(raw[:8], "little")
    head = json.loads(raw[8 : 8 + size])
    return {k: np.frombuffer(raw, np.dtype(d), n, 8 + size + at) if n else np.empty(0, np.dtype(d)) for k, (d, at, n) in head["places"].items()}, head["notes"]


def press(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays pressed, bytes of the same weight side by side, so that the many zeros press well."""
    planes = {k: np.ascontiguousarray(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize).T).ravel() if len(v) else np.empty(0, np.uint8) for k, v in arrays.items()}
    return zstandard.ZstdCompressor(1).compress(layout(planes, {k: v.dtype.str for k, v in arrays.items()}))


def unpress(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of :func:`press`."""
    planes, kinds = laid_out(zstandard.ZstdDecompressor().decompress(raw))
    return {k: np.ascontiguousarray(v.reshape(np.dtype(kinds[k]).itemsize, -1).T).view(kinds[k]).ravel() if len(v) else np.empty(0, kinds[k]) for k, v in planes.items()}

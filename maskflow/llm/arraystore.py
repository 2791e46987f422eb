"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

Where the shared folder is mounted, arrays are mapped in place.  From another
store a worker copies a shard to its own temporary folder, maps it and unlinks it
at once.  A worker keeps the last ``MOST_OPEN`` shards mapped, so that neither its
maps nor its copies grow with the model.  A file is written under a name of the attempt and then renamed, so a
task that runs again after a lost executor leaves the same file.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np

from maskflow.llm.shared import local_path

#: Shards that a worker keeps mapped.
MOST_OPEN = 512


class ArrayStore:
    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, array: np.ndarray) -> None:
        folder = local_path(self.uri)
        attempt = f".{name}.{uuid.uuid4().hex}"
        if folder is not None:
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{attempt}", "wb") as f:
                np.lib.format.write_array(f, np.ascontiguousarray(array), allow_pickle=False)
            os.replace(f"{folder}/{attempt}", f"{folder}/{name}.npy")
            return
        store, path = self._remote()
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{attempt}") as f:
            np.lib.format.write_array(f, np.ascontiguousarray(array), allow_pickle=False)
        store.move(f"{path}/{attempt}", f"{path}/{name}.npy")

    def read(self, name: str) -> np.ndarray | None:
        """The mapped array, or None if there is none of that name."""
        folder = local_path(self.uri)
        if folder is not None:
            path = f"{folder}/{name}.npy"
            return _mapped(path) if os.path.exists(path) else None
        store, path = self._remote()
        from pyarrow import fs

        if store.get_file_info(f"{path}/{name}.npy").type == fs.FileType.NotFound:
            return None
        with tempfile.NamedTemporaryFile(suffix=".npy") as own:
            with store.open_input_stream(f"{path}/{name}.npy") as f:
                shutil.copyfileobj(f, own)
            own.flush()
            return _mapped(own.name)


def _mapped(path: str) -> np.ndarray:
    array = np.load(path, mmap_mode="r", allow_pickle=False)
    return array if array.size else np.array(array)


class Shards:
    """Values by 64-bit hash: shard s holds the hashes whose top bits are s, sorted, with columns beside them."""

    def __init__(self, uri: str, bits: int, columns: tuple[str, ...], prefix: str = ""):
        self.store, self.bits, self.columns, self.prefix = ArrayStore(uri), bits, columns, prefix
        self.open: dict[int, dict[str, np.ndarray | None]] = {}  # the last used at the end

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def write(self, shard: int, hashes: np.ndarray, *columns: np.ndarray) -> None:
        for name, array in zip(self.columns, columns):
            self.store.write(f"{self.prefix}{shard}-{name}", array)
        self.store.write(f"{self.prefix}{shard}-hash", hashes)

    def array(self, shard: int, name: str) -> np.ndarray | None:
        """One of a shard's arrays, mapped; None if the shard is empty."""
        arrays = self.open.pop(shard, None)
        if arrays is None:
            arrays = {}
            while len(self.open) >= MOST_OPEN:
                del self.open[next(iter(self.open))]
        self.open[shard] = arrays
        if name not in arrays:
            arrays[name] = self.store.read(f"{self.prefix}{shard}-{name}")
        return arrays[name]

    def shard(self, shard: int) -> tuple[np.ndarray | None, ...]:
        return tuple(self.array(shard, name) for name in ("hash", *self.columns))

    def runs(self, ordered: np.ndarray):
        """(shard, begin, end) for ascending hashes."""
        if len(ordered):
            shards = self.shard_of(ordered)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(ordered)]])
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield int(shards[b]), b, e

    def look_up(self, ordered: np.ndarray) -> list[np.ndarray]:
        """Found flags, then each column's values (0 where not found), for ascending hashes."""
        found = np.zeros(len(ordered), bool)
        out: list[np.ndarray] = []
        for s, b, e in self.runs(ordered):
            hashes, *columns = self.shard(s)
            if not out:
                out = [None] * len(self.columns)
            if hashes is None or not len(hashes):
                continue
            at = np.minimum(np.searchsorted(hashes, ordered[b:e]), len(hashes) - 1)
            hit = hashes[at] == ordered[b:e]
            found[b:e] = hit
            for k, c in enumerate(columns):
                if out[k] is None:
                    out[k] = np.zeros(len(ordered), c.dtype)
                out[k][b:e][hit] = c[at[hit]]
        return [found, *[np.zeros(len(ordered), np.int64) if o is None else o for o in (out or [None] * len(self.columns))]]


def shard_bits(partitions: int, least: int = 4) -> int:
    """Top bits for about eight shards to each partition of the input, so shards keep their size as the input grows."""
    return max(least, (max(1, partitions) * 8 - 1).bit_length())


class Objects:
    """Whole files of a shared folder, written at once and read by ranges."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def put(self, name: str, data: bytes) -> None:
        folder, attempt = local_path(self.uri), f".{name}.{uuid.uuid4().hex}"
        if folder is not None:
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{attempt}", "wb") as f:
                f.write(data)
            os.replace(f"{folder}/{attempt}", f"{folder}/{name}")
            return
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{attempt}") as f:
            f.write(data)
        store.move(f"{path}/{attempt}", f"{path}/{name}")

    def open(self, name: str):
        """A file that can be sought and read."""
        folder = local_path(self.uri)
        if folder is not None:
            return open(f"{folder}/{name}", "rb")
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        return store.open_input_file(f"{path}/{name}")

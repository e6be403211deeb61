"""Files that tasks share: written once under the cluster's checkpoint folder, read or memory-mapped by workers."""

from __future__ import annotations

import contextlib
import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.plans.lineage import checkpoint_dir

#: Rows of a few integers that may be broadcast (tens of MB); beyond that a join is shuffled.
BROADCAST_ROWS = 1_000_000


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a folder of this run under ``spark.checkpoint.dir``, which driver and executors share."""
    base = checkpoint_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[len("file:") :].lstrip("/")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Folder:
    """A shared folder in any file system Arrow can reach; picklable, opened where it is used."""

    def __init__(self, uri: str):
        self.uri = uri
        self._fs = self._path = None

    def __reduce__(self):
        return Folder, (self.uri,)

    def _open(self):
        if self._fs is None:
            self._fs, self._path = pafs.FileSystem.from_uri(self.uri)
        return self._fs, self._path

    def write(self, name: str, *parts) -> None:
        """Write a file under a name of its own and move it in place: a repeated task leaves one whole file."""
        with self.writer(name) as out:
            for part in parts:
                out.write(part)

    @contextlib.contextmanager
    def writer(self, name: str):
        fs, path = self._open()
        fs.create_dir(path, recursive=True)
        draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            yield out
        fs.move(draft, f"{path}/{name}")

    def open(self, name: str):
        fs, path = self._open()
        return fs.open_input_file(f"{path}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def mapped(self, name: str, dtype: str) -> np.ndarray:
        """The file as a read-only memory-mapped array.

        On a file system mounted on the worker it is mapped in place.  From any
        other one it is copied to a temporary file that is already unlinked when
        it is mapped, so that it goes with the worker.
        """
        fs, path = self._open()
        if isinstance(fs, pafs.LocalFileSystem):
            file = open(f"{path}/{name}", "rb")
        else:
            file = tempfile.TemporaryFile()
            with fs.open_input_stream(f"{path}/{name}") as source:
                while block := source.read(1 << 24):
                    file.write(block)
            file.flush()
        with file:
            if not os.fstat(file.fileno()).st_size:
                return np.empty(0, dtype)
            return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype)

    def delete(self) -> None:
        fs, path = self._open()
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_dir(path)


def checked(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few integers, marked for broadcast while it has few rows."""
    return F.broadcast(table) if table.count() <= rows else table

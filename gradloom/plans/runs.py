"""Versions of a run on shared storage: a run that stops anywhere goes on as if it had not.

A version holds the state table (point, gradient, stored pairs), the scalars with the Gram
matrix, and the objective's cursor, so that the next batch is the one that would have come.
It counts from the moment its manifest is renamed into place; a version that was not finished
is never read.  Older versions go only after that.

All files are reached through Spark's own file systems, so the folder may be wherever
Spark can write.  One run writes to a folder at a time.
"""

from __future__ import annotations

import json
from dataclasses import replace
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import SparkSession

if TYPE_CHECKING:
    from gradloom.plans.objectives import Objective
    from gradloom.plans.optimizers import State

SCALARS = ("value", "adjusted_value", "grad_norm", "iteration", "initial_value", "history", "search_failed", "reason", "alpha")
_PREFIX = "manifest-"


class Files:
    """Small files in any file system Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a draft and rename it: a reader sees the whole file or none."""
        draft = self._path(f".draft-{name}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(name)):
            raise OSError(f"{self.folder}/{name} could not be put in place")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class RunStore:
    """Saved versions of one run; the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 1, files: int | None = None):
        if keep < 1:
            raise ValueError("at least one version must stay")
        self.spark, self.keep, self.files = spark, keep, files
        self._files = Files(spark, folder)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(name[len(_PREFIX) :]) for name in self._files.names() if name.startswith(_PREFIX))

    def save(self, state: "State", objective: "Objective | None" = None) -> int:
        """Commit the state, and where the objective is in its data, as a new version."""
        names = self._files.names()
        # Above unfinished versions too: their folders may be half written.
        version = 1 + max([0, *(int(name.split("-")[-1]) for name in names if name.startswith((_PREFIX, "table-")))])
        table = state.table.repartition(self.files) if self.files else state.table
        table.write.parquet(f"{self._files.folder}/table-{version}")
        content = {name: getattr(state, name) for name in SCALARS}
        content |= {"keys": list(state.keys), "trace": list(state.trace), "gram": None if state.gram is None else np.asarray(state.gram).tolist()}
        content["cursor"] = objective.cursor() if objective is not None else None
        self._files.publish(f"{_PREFIX}{version}", json.dumps(content))
        self._clear(version)
        return version

    def _clear(self, version: int) -> None:
        kept = set(self.versions()[-self.keep :])
        for prefix in (_PREFIX, "table-"):  # manifests first: a version without its table would not be whole
            for name in self._files.names():
                if name.startswith(prefix) and (number := int(name[len(prefix) :])) not in kept and number < version:
                    self._files.remove(name)

    def load(self, objective: "Objective | None" = None, version: int | None = None) -> "State":
        """The last version, or the one asked for; the objective goes to where it was."""
        from gradloom.plans.optimizers import State

        versions = self.versions()
        if not versions or version is not None and version not in versions:
            raise FileNotFoundError(f"no saved version {'' if version is None else version} in {self._files.folder}")
        version = versions[-1] if version is None else version
        content = json.loads(self._files.read(f"{_PREFIX}{version}"))
        cursor, gram = content.pop("cursor"), content.pop("gram")
        content["keys"], content["trace"] = tuple(content["keys"]), tuple(content["trace"])
        if objective is not None and cursor is not None:
            objective.restore(cursor)
        table = self.spark.read.parquet(f"{self._files.folder}/table-{version}")
        return State(table=table, gram=None if gram is None else np.array(gram), **content)

    def resume(self, objective: "Objective") -> "State | None":
        """The state to go on from, its verdict taken back; None for a run that has not begun."""
        return replace(self.load(objective), reason=None, search_failed=False) if self.versions() else None

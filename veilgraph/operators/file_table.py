"""A table whose cells are deleted in place: only files that hold a requested key are written anew, and a version can be taken back.

A version is a list of files (its manifest). A deletion finds the files that hold requested keys by reading the key column alone, writes
their rows without the requested cells to new files, and then names the new list as the next version, by one rename that fails if
somebody else was faster. Readers see one version or the other. Files of earlier versions stay until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators.deletion import BROADCAST_ROWS, mask_to_null
from veilgraph.store import file_system


class VersionError(ValueError):
    """A version that isn't there, or that somebody else has written meanwhile."""


class FileTable:
    """Parquet files below ``path`` and their versions. ``key`` is the column that requests name."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def create(self, rows: DataFrame) -> int:
        """Version 0; a table that is there already is an error."""
        if self.versions():
            raise VersionError(f"{self.path} holds a table already")
        return self._commit(0, self._written(rows))

    def versions(self) -> list[int]:
        where, system = file_system(self.spark, f"{self.path}/versions")
        if not system.exists(where):
            return []
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def files(self, version: int | None = None) -> list[str]:
        """The files of a version, the last one if none is named."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise VersionError(f"{self.path} has no version {version}" if known else f"{self.path} holds no table")
        number = known[-1] if version is None else version
        return sorted(r.value for r in self.spark.read.text(f"{self.path}/versions/{number}").collect())  # a row for each file

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A file is read with the schema of the first, as all come from one table."""
        return self.spark.read.parquet(*self.files(version))

    def touched(self, requests: DataFrame, version: int | None = None) -> list[str]:
        """The version's files that hold a key of the requests. Only the key column is read."""
        keys = requests.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        held = self.read(version).select(self.key, F.col("_metadata.file_path").alias("__file"))
        found = held.join(F.broadcast(keys) if few else keys, self.key, "left_semi").select("__file").distinct()
        return sorted(r["__file"] for r in found.collect())  # a row for each file

    def delete_cells(self, requests: DataFrame) -> int:
        """The version without the requested cells (key, names), as ``mask_to_null`` sets them to null. If anything fails the last version stays."""
        last = self.versions()[-1] if self.versions() else None
        files = self.files(last)
        old = set(self.touched(requests, last))
        if not old:
            return last
        rows = self.spark.read.parquet(*sorted(old))
        new = self._written(mask_to_null(rows, requests, self.key))
        plain = lambda f: f.split(":", 1)[-1].replace("///", "/")  # noqa: E731  with or without the scheme
        gone = {plain(f) for f in old}
        return self._commit(last + 1, [f for f in files if plain(f) not in gone] + new)

    def roll_back(self, version: int) -> int:
        """A new version with the files of an earlier one."""
        return self._commit(self.versions()[-1] + 1, self.files(version))

    def vacuum(self) -> int:
        """Forgets all versions but the last and removes files that it doesn't name; returns how many went."""
        kept = {f.rsplit("/", 1)[-1] for f in self.files()}
        for number in self.versions()[:-1]:
            where, system = file_system(self.spark, f"{self.path}/versions/{number}")
            system.delete(where, True)
        where, system = file_system(self.spark, f"{self.path}/data/*/part-*")
        spare = [s.getPath() for s in system.globStatus(where) if s.getPath().getName() not in kept]
        for path in spare:
            system.delete(path, False)
        return len(spare)

    def _written(self, rows: DataFrame) -> list[str]:
        """New files of rows, or none at all if writing fails."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(place)
        except (PySparkException, OSError):
            where, system = file_system(self.spark, place)
            system.delete(where, True)
            raise
        where, system = file_system(self.spark, f"{place}/part-*")
        return [s.getPath().toString() for s in system.globStatus(where)]

    def _commit(self, number: int, files: list[str]) -> int:
        made = f"{self.path}/versions/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(f,) for f in sorted(files)], "value string").coalesce(1).write.text(made)
        source, system = file_system(self.spark, made)
        target, _ = file_system(self.spark, f"{self.path}/versions/{number}")
        if system.exists(target) or not system.rename(source, target):
            system.delete(source, True)
            raise VersionError(f"version {number} of {self.path} was written by somebody else")
        return number

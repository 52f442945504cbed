"""Several tables under one version: all of a change is seen, or none of it.

Tables are written beside the ones that are read; then one small file, a
manifest, names what belongs to the new version. It is put in place by a rename
to a name that must not exist, so that of two writers one fails and nothing is
half visible. A reader holds a version and goes on seeing it.

    store = Versions(spark, "hdfs://.../cache")
    store.publish({"searches": df, "results": df2})
    now = store.open()
    now["results"]
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _store


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Version(Mapping):
    """The tables of one version, by name."""

    def __init__(self, spark: SparkSession, number: int, paths: dict[str, dict]):
        self.spark, self.number, self.paths = spark, number, paths

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.paths[name]["schema"]).parquet(self.paths[name]["path"])

    def __iter__(self):
        return iter(self.paths)

    def __len__(self) -> int:
        return len(self.paths)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        where, self.fs = _store(spark, root)
        self.root = self.fs.makeQualified(where).toString()

    def _path(self, name: str):
        return _store(self.spark, f"{self.root}/{name}")[0]

    def numbers(self) -> list[int]:
        """All versions in order."""
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def open(self, number: int | None = None) -> Version:
        """A version, the newest if none is given; before the first one, without tables."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version(self.spark, 0, {})
        text = self.spark.read.text(self._path(f"manifests/{number}.json").toString(), wholetext=True).first()[0]
        return Version(self.spark, number, json.loads(text))

    def publish(self, tables: dict[str, DataFrame], base: Version | None = None) -> Version:
        """A new version after `base` (the newest): these tables, and base's others as they are. Raises Conflict if base has a successor by then."""
        base = base or self.open()
        paths = dict(base.paths)
        for name, df in tables.items():
            path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            paths[name] = {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(part)
        out.write(bytearray(json.dumps(paths), "utf-8"))
        out.close()
        number = base.number + 1
        try:
            done = not self.fs.exists(self._path(f"manifests/{number}.json")) and self.fs.rename(part, self._path(f"manifests/{number}.json"))
        except Exception as e:  # stores differ in whether a name that is taken is an error or a refusal
            self.fs.delete(part, False)
            raise Conflict(f"version {number} exists") from e
        if not done:
            self.fs.delete(part, False)
            raise Conflict(f"version {number} exists")
        return Version(self.spark, number, paths)


def purged(tables: Mapping, children: dict[str, list[tuple[str, str, str]]], name: str, keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """What tables become when rows of `name` with these keys go, and with them their children, and theirs.

    children: for each table (child, its column, the parent's column). A table that is reached twice loses what either way removes.
    """
    out: dict[str, DataFrame] = {}

    def cut(name: str, gone: DataFrame, key: str) -> None:
        now = out.get(name, tables[name])
        for child, own, parent in children.get(name, []):
            rows = tables[name].join(gone, key, "left_semi")
            cut(child, rows.select(F.col(parent).alias(own)).filter(F.col(own).isNotNull()).distinct(), own)
        out[name] = now.join(gone, key, "left_anti")

    cut(name, keys.select(key).distinct(), key)
    return out

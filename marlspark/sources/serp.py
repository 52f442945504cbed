"""Search results as a data source: stored answers of a provider, one JSON document a line.

    stored_results(spark, "hdfs://.../answers/*.jsonl", "ddg")

reads them from any store that Spark reads. The data source

    spark.dataSource.register(SerpSource)
    spark.read.format("serp").load("/answers/*.jsonl")

opens files itself: it is for folders that are mounted on all machines. A
provider is chosen by name: `serper` or `ddg`.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

PROVIDERS = {"serper": ("organic", "news", "videos", "scholar"), "ddg": ("organic", "news", "videos"), "duckduckgo": ("organic", "news", "videos")}


def provider(name: str | None) -> str:
    """The provider of that name; others are the default."""
    n = (name or "").lower()
    return "ddg" if n in ("ddg", "duckduckgo") else "serper"


_ITEM = "array<struct<link:string,href:string,url:string,title:string,snippet:string,body:string>>"


def stored_results(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """query, kind, position, link, title, snippet of stored answers, a JSON document a line. Items without a link are left out."""
    kinds = PROVIDERS[provider(name)]
    a = spark.read.text(path).select(F.from_json("value", f"query string, {', '.join(f'{k} {_ITEM}' for k in kinds)}").alias("a"))
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"a.{k}").alias("items")) for k in kinds])
    r = a.select("a.query", F.explode(lists).alias("l")).select("query", "l.kind", F.posexplode("l.items").alias("position", "i"))
    some = lambda *names: F.coalesce(*[F.nullif(f"i.{n}", F.lit("")) for n in names[:-1]], F.col(f"i.{names[-1]}"))
    return r.select("query", "kind", "position", some("link", "href", "url").alias("link"), "i.title", some("snippet", "body").alias("snippet")).filter("link IS NOT NULL")


NAMES = ("query", "kind", "position", "link", "title", "snippet")
ROWS = 4096


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))


def _batches(paths: tuple[str, ...], kinds: tuple[str, ...], queries: frozenset | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of these kinds, and of these queries if some are given, with these columns."""
    types = {n: pa.int32() if n == "position" else pa.string() for n in NAMES}
    schema = pa.schema([(n, types[n]) for n in names])
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[NAMES.index(n)] for r in rows], types[n]) for n in names], schema=schema)

    for path in paths:
        with open(path, encoding="utf-8") as f:
            for line in f:
                a = json.loads(line) if line.strip() else {}
                if queries is not None and a.get("query") not in queries:
                    continue
                for kind in kinds:
                    for i, item in enumerate(a.get(kind) or []):
                        link = item.get("link") or item.get("href") or item.get("url")
                        if link is not None:
                            rows.append((a.get("query"), kind, i, link, item.get("title"), item.get("snippet") or item.get("body")))
                            if len(rows) >= ROWS:
                                yield out()
                                rows = []
    if rows:
        yield out()


class SerpReader(DataSourceReader):
    """Answers' files, a partition each; only the schema's columns are made."""

    def __init__(self, options: dict, schema):
        self.path, self.kinds, self.queries, self.names = options["path"], PROVIDERS[provider(options.get("provider"))], None, list(schema.names)

    def partitions(self) -> list[InputPartition]:
        return [_Files([p]) for p in sorted(glob.glob(self.path))] if self.kinds else []

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.value, self.kinds, self.queries, self.names)


class FilteringReader(SerpReader):
    """Takes filters on kind and query (equal, or one of several) on itself.

    Spark refuses such a reader unless spark.sql.python.filterPushdown.enabled is set, so that the option `push` asks for it. It also
    keeps a loaded source's reader with the filters that it was given first: load the source anew for each filter.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("kind",):
                self.kinds = tuple(k for k in self.kinds if k in wanted)
            elif wanted is not None and f.attribute == ("query",):
                self.queries = frozenset(wanted) if self.queries is None else self.queries & wanted
            elif not (isinstance(f, IsNotNull) and f.attribute == ("kind",)):  # a kind is never null
                yield f


class SerpStreamReader(DataSourceStreamReader):
    """New files of answers. An offset is the number of files in order of their time and name; a file must appear whole, with a time not before others'."""

    def __init__(self, options: dict, schema):
        self.path, self.kinds, self.names = options["path"], PROVIDERS[provider(options.get("provider"))], list(schema.names)

    def _files(self) -> list[str]:
        return [p for _, p in sorted((os.stat(p).st_mtime_ns, p) for p in glob.glob(self.path))]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Files([p]) for p in self._files()[start["files"] : end["files"]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.value, self.kinds, None, self.names)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class SerpSource(DataSource):
    """Readers of stored answers; a schema with some of the columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "serp"

    def schema(self) -> str:
        return "query string, kind string, position int, link string, title string, snippet string"

    def reader(self, schema) -> SerpReader:
        return (FilteringReader if self.options.get("push") == "true" else SerpReader)(self.options, schema)

    def streamReader(self, schema) -> SerpStreamReader:
        return SerpStreamReader(self.options, schema)

"""Files as sources and sinks: JSON documents by URL hash, PDF validation."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.urls import short_hash


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results, whose file names begin with the URL's hash."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("url_hash", F.regexp_extract(F.input_file_name(), r"([0-9a-f]{16})_[^/]*$", 1))


def results_of(urls: DataFrame, results: DataFrame) -> DataFrame:
    return urls.withColumn("url_hash", short_hash(F.col("url"))).join(results, "url_hash", "left")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def pdf_problem(length: Column, content: Column, most_mb: int = 500) -> Column:
    """Why a file isn't a PDF to be read; null if nothing speaks against it."""
    return F.when(length == 0, "empty").when(length > most_mb * 1048576, "too large").when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "no PDF header")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class DocumentWriter(DataSourceWriter):
    """Tasks write below a hidden folder; the commit moves their files to their names, and an abort removes them all. A file of that name before is replaced."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.staged = path, kind, f"{path}/.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        own = f"{self.staged}/{uuid.uuid4().hex}"
        os.makedirs(own, exist_ok=True)
        names = []
        for r in iterator:
            name = f"{hashlib.md5(r.url.encode()).hexdigest()[:16]}_{self.kind}.json"
            with open(f"{own}/{name}", "w", encoding="utf-8") as f:
                f.write(r.document)
            names.append(f"{own}/{name}")
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for name in m.names if m else []:
                os.replace(name, f"{self.path}/{os.path.basename(name)}")
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class DocumentSink(DataSource):
    """One JSON file for each row (url, document), named by the URL's hash; for folders that are mounted on all machines.

        spark.dataSource.register(DocumentSink)
        df.write.format("documents").option("kind", "extracted").mode("append").save("/mounted/results")
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "url string, document string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("kind", "extracted"))

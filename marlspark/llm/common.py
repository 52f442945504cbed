"""What the training-data operators share: column picking, Arrow mapping, and tables in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, fresh_path, materialize  # noqa: F401

#: Bytes of an Arrow batch, which has one row at least. Texts can be long, so that rows alone bound nothing.
BATCH_BYTES = "4m"

def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name and position, whatever else df has (names that clash in case, dots, duplicates)."""
    columns = df.columns
    at = [columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with null texts as they are."""
    bounded(df.sparkSession)
    return pick(df, "doc_id", "text", *more)


def map_texts(df: DataFrame, columns: str, make: Callable[[], Callable[[list], Iterable]], value: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Map column `value` to new columns, in Arrow batches; `keep` passes through.

    columns: the new columns as DDL. make() is called once a task and returns
    a function from a list of values (None for null) to one list for each new column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = [df.schema[k] for k in keep] + list(StructType.fromDDL(columns))
    schema = StructType(fields)
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches):
        f = make()
        for b in batches:
            if not b.num_rows:
                continue
            cols = f(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(c, type=arrow.field(n + i).type) for i, c in enumerate(cols)],
                names=arrow.names,
            )

    return df.select(*keep, value).mapInArrow(run, schema)


def remainder(n: int):
    """crc32(doc_id as text) mod n as a column; a null doc_id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.lit(n)


class Files:
    """Files below a folder that driver and executors share: a local or mounted path, or any store that pyarrow can open."""

    def __init__(self, uri: str):
        scheme = urlparse(uri).scheme
        self.local = scheme in ("", "file")
        self.uri = uri
        self.root = re.sub("/+", "/", unquote(urlparse(uri).path)) if self.local else uri

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all; writing again replaces it, so that a task can be repeated."""
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{self.root}/{name}")
        else:
            store, root = self._fs()
            store.create_dir(root, recursive=True)
            part = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(data)
            store.move(part, f"{root}/{name}")

    def read(self, name: str, at: int, size: int) -> bytes:
        """A part of a file in a store that isn't mounted."""
        store, root = self._fs()
        with store.open_input_file(f"{root}/{name}") as f:
            f.seek(at)
            return f.read(size)

    def open(self, name: str):
        """The file's bytes: mapped into memory where the folder is mounted, else read."""
        import numpy as np

        if self.local:
            path = f"{self.root}/{name}"
            return np.asarray(np.memmap(path, dtype=np.uint8, mode="r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
        store, root = self._fs()
        with store.open_input_file(f"{root}/{name}") as f:
            return np.frombuffer(f.read(), dtype=np.uint8)

"""Vector search by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded
from .ranking import top_per_key


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(n == 0, 0.0).otherwise(_dot(a, b) / n)


def search(chunks: DataFrame, vector: list[float], limit: int = 20, threshold: float | None = None, doc_type: str | None = None, urls: DataFrame | None = None) -> DataFrame:
    """The `limit` chunks nearest to a query vector: each task keeps its own best, so that what is gathered doesn't grow with the table."""
    if doc_type:
        chunks = chunks.filter(F.col("doc_type") == doc_type)
    if urls is not None:
        chunks = chunks.join(urls, "url", "left_semi")
    scored = chunks.withColumn("similarity", F.round(cosine(F.col("embedding"), F.lit(vector)), 6))
    if threshold is not None:
        scored = scored.filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.col("similarity").desc(), "chunk_id").limit(limit).select("url", "doc_type", "chunk_id", "similarity")


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.9, "Excellent").when(similarity >= 0.8, "Very Good").when(similarity >= 0.7, "Good").otherwise("Fair")


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits by URL with parallel arrays in rank order."""
    g = hits.groupBy("url").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("chunk_id").alias("c")))).alias("h"))
    return g.select("url", F.transform("h", lambda x: x["c"]).alias("chunk_ids"), F.transform("h", lambda x: -x["s"]).alias("scores"), F.size("h").alias("n_hits"))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store (url, chunk_id, ...) after whole documents were stored anew: what a document had before is gone."""
    return old.join(new.select("url").distinct(), "url", "left_anti").unionByName(new)


def delete_documents(store: DataFrame, urls: DataFrame) -> DataFrame:
    return store.join(urls.select("url").distinct(), "url", "left_anti")


def document_chunks(store: DataFrame, url: str) -> DataFrame:
    """One document's chunks in order."""
    return store.filter(F.col("url") == url).orderBy("chunk_id")


def newest(store: DataFrame, limit: int = 10_000) -> DataFrame:
    """The newest chunks by created_at, as the search loads them. Equal times go by url and chunk_id."""
    return store.orderBy(F.col("created_at").desc(), "url", "chunk_id").limit(limit)


def embedding_states(old: DataFrame, events: DataFrame) -> DataFrame:
    """url, status, updated_at, error after events (url, event: start, complete, fail; at; error). The last event counts."""
    new = events.select("url", F.element_at(F.create_map(*[F.lit(x) for x in ("start", "processing", "complete", "completed", "fail", "failed")]), F.col("event")).alias("status"), F.col("at").alias("updated_at"), "error")
    last = F.max_by(F.struct("status", "updated_at", "error"), F.struct("updated_at", "status"))
    return old.select("url", "status", "updated_at", "error").unionByName(new).groupBy("url").agg(last.alias("s")).select("url", "s.*")


def to_embed(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Documents to embed: those never embedded, and those that failed; not those in work or done."""
    return documents.join(states.filter("status IN ('processing', 'completed')").select("url"), "url", "left_anti")


def _as_blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """ids and matrix (unit vectors, as bytes of doubles) of at most `most` rows each, from Arrow batches as they come. Null vectors are left out; one without a length stays zero."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                b = batch.slice(at, most)
                b = b.filter(b.column(1).is_valid())
                if b.num_rows:
                    m = np.array(b.column(1).to_pylist(), np.float64)
                    n = np.sqrt((m * m).sum(1, keepdims=True))
                    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "matrix"])

    return rows.select(F.col(key).cast("bigint").alias("id"), "embedding").mapInArrow(run, "ids array<bigint>, matrix binary")


def search_many(queries: DataFrame, chunks: DataFrame, limit: int = 20, threshold: float | None = None, block: int = 512, key: str = "chunk_id") -> DataFrame:
    """query_id, rank, key and similarity of the `limit` chunks nearest to each of many queries (query_id, embedding), without a chunk of the query's own id.

    Vectors are read once, in blocks; a block meets each block of queries as one matrix product. A task keeps
    `limit` hits of each query of the block that it is at, so that what is merged is queries times tasks. Query
    blocks are joined, not broadcast, in several copies where there are fewer of them than partitions. Equal similarities go by key.
    """
    spark = chunks.sparkSession
    bounded(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-queries.count() // block))
    copies = max(1, -(-n // parts))
    q = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).filter("embedding IS NOT NULL")
    q = q.groupBy("part").agg(F.collect_list(F.struct(F.col("query_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))).alias("q"))
    q = q.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    v = _as_blocks(chunks, key, 4096).withColumn("copy", F.pmod(F.xxhash64(F.get("ids", 0)), F.lit(copies)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = v.join(q, ["part", "copy"]).select("part", "q", "ids", "matrix").sortWithinPartitions("part")
    names = ["query_id", key, "similarity"]

    def best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > limit:
            least = np.partition(scores, len(scores) - limit)[len(scores) - limit]
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[:limit]
        return scores[order], ids[order]

    def run(batches):
        part, own, matrix, kept = None, [], None, []

        def out():
            rows = [(i, k, s) for i, (ss, ks) in zip(own, kept, strict=True) for s, k in zip(ss.tolist(), ks.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield out()
                    part, own = row["part"], [x["id"] for x in row["q"]]
                    matrix = np.array([x["v"] for x in row["q"]])
                    norm = np.sqrt((matrix * matrix).sum(1, keepdims=True))
                    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
                    kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
                ids = np.array(row["ids"], np.int64)
                scores = np.round(matrix @ np.frombuffer(row["matrix"], np.float64).reshape(len(ids), -1).T, 6) + 0.0
                for j, me in enumerate(own):
                    mine = ids != me if threshold is None else (ids != me) & (scores[j] >= threshold)
                    kept[j] = best(np.concatenate([kept[j][0], scores[j][mine]]), np.concatenate([kept[j][1], ids[mine]]))
        if part is not None:
            yield out()

    hits = met.mapInArrow(run, f"query_id bigint, {key} bigint, similarity double")
    return top_per_key(hits, ["query_id"], [F.col("similarity").desc(), F.col(key)], limit, "rank")

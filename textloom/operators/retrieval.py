"""Retrieval by cosine similarity over stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.memory import tidy
from textloom.operators.names import mentions


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


#: Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 21


def _scored(queries, k: int, exclude_self: bool):
    """For each query the rows of a task that are among its k best so far, or within rounding of the k-th."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        blocks = {n: (np.array(ids), np.array(q)) for n, (ids, q) in queries.value.items()}
        best = {n: np.full((len(ids), k), -np.inf) for n, (ids, _) in blocks.items()}
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for n, (ids, q) in blocks.items():
                whole = np.nonzero(sizes == n)[0]
                step = max(1, SCORES_AT_ONCE // len(ids))
                for low in range(0, len(whole), step):
                    at = whole[low : low + step]
                    m = flat[starts[at][:, None] + np.arange(n)].astype(float)
                    norm = np.sqrt((m * m).sum(axis=1))
                    at, m, norm = at[norm > 0], m[norm > 0], norm[norm > 0]
                    s = q @ (m / norm[:, None]).T
                    if exclude_self:
                        s[ids[:, None] == keys[at][None, :]] = -np.inf
                    top = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :] if s.shape[1] > k else s
                    best[n] = np.sort(np.concatenate([best[n], top], axis=1), axis=1)[:, -k:]
                    i, j = np.nonzero(s >= np.maximum(best[n][:, 0] - 1e-5, -2)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(keys[at][j]), pa.array(s[i, j])], ["query_id", "key", "similarity"])
        tidy()

    return run


def most_similar(queries: DataFrame, index: DataFrame, k: int = 3, query_id: str = "query_id", key: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, at_once: int = 4096) -> DataFrame:
    """The k best rows of the index for each query: query_id, rank, key, similarity (5 places); ties to the smaller key. Ids are integers.

    Queries go to the index in blocks of about ``at_once``, each broadcast; slices of the index meet a block in one matrix product each, and a task returns
    k rows or so for each query. Vectors that are null, zero or of another dimension than the query take no part.
    """
    import numpy as np

    from textloom.session import ship
    from textloom.storage import materialise

    spark = index.sparkSession
    ship(spark)
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).filter("q is not null and not exists(q, x -> x is null)")
    d = index.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    blocks = max(1, -(-q.count() // at_once))
    found = None
    for b in range(blocks):
        held: dict[int, tuple[list, list]] = {}
        for r in q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect():
            x = np.array(r.q)
            n = float(np.sqrt((x * x).sum()))
            if n > 0:
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append(r.query_id)
                rows.append(x / n)
        sent = spark.sparkContext.broadcast(held)
        part = d.mapInArrow(_scored(sent, k, exclude_self), "query_id bigint, key bigint, similarity double")
        if blocks > 1:  # one block at a time stays with the executors
            part = materialise(part, "similar-block")
            sent.unpersist()
        found = part if found is None else found.union(part)
    s = found.withColumn("similarity", F.round("similarity", 5))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key"))
    return s.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "similarity")


def nearest(index: DataFrame, query: list[float], k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for one query vector, by a bounded sort."""
    s = index.withColumn("similarity", F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 5))
    return s.orderBy(F.desc("similarity"), key).limit(k)


def best_above(queries: DataFrame, index: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Each query's best row if it is similar enough."""
    return most_similar(queries, index, k=1, **options).filter(F.col("similarity") >= threshold)


def parents(hits: DataFrame, small: DataFrame, key: str = "chunk_id", parent: str = "doc_id") -> DataFrame:
    """The large chunks to which the found small chunks belong, best hit first."""
    joined = hits.join(small.select(key, parent), key)
    return joined.groupBy("query_id", parent).agg(F.max("similarity").alias("similarity"))


def progressive(queries: DataFrame, index: DataFrame, chunk_index: DataFrame, parent: str = "doc_id", key: str = "chunk_id", k: int = 1) -> DataFrame:
    """The best document for each query, then the best chunks of that document."""
    top = most_similar(queries, index, 1, key=parent).select("query_id", parent)
    q = queries.select("query_id", unit(F.col("embedding")).alias("q")).join(top, "query_id")
    s = q.join(chunk_index, parent).select("query_id", parent, key, F.round(dot(F.col("q"), unit(F.col("embedding"))), 5).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mentioned(batches: DataFrame, names: DataFrame, compat: bool = False) -> DataFrame:
    """Names (file, name) of a file's dependencies that stand in its batches of lines (file, text), as whole identifiers; with ``compat`` as parts of others too."""
    if compat:
        return batches.join(names, "file").filter(F.contains("text", "name"))
    told = batches.withColumn("__h", F.xxhash64("text"))
    hits = mentions(told, names, "file", *[c for c in told.columns if c not in ("file", "text")])
    return told.join(hits, [c for c in told.columns if c != "text"]).drop("__h").join(names, ["file", "name"]).select(*batches.columns, *[c for c in names.columns if c != "file"])

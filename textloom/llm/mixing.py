"""Mixing sources to target weights by systematic sampling.

Targets: each source gets its weight's share of all words, at most ``most`` times its own size; what a stopped source leaves goes
to the others by weight, until none is above. That is one water level: with the sources in ascending order of cap / weight,
those stop whose cap is not above the level that remains for them and the rest.

Sampling: a source's documents are put in order of size, so that long ones are spread evenly over the sample. Each expects
target / size copies; their prefix sum plus one random offset of the source crosses integers, and each crossing emits the
document once. The prefix sum is distributed: a range shuffle orders the documents, each task numbers its own, and only one count for
each task and source is summed centrally.

Defined results: a null text has size 0, a null source is a source of its own and comes last. A source without words has
target 0 and gives nothing. Repeated rows count as often as they occur. Documents without words may be chosen and add nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import count_words, fresh, map_batches
from textloom.session import ship
from textloom.storage import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size, n_docs), one row per source, the same with target and rate (expected copies of a document).

    The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(level), F.lit(0)))
        .withColumn("weight_left", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(level), F.lit(0)))
        .withColumn("stops", F.col("cap").cast("double") * F.col("weight_left") <= F.col("left").cast("double") * F.col("w"))
    )
    rest = F.sum("source_size").over(everywhere) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everywhere), F.lit(0))
    weight = F.sum(F.when(~F.col("stops"), F.col("w"))).over(everywhere)
    ranked = ranked.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(rest.cast("double") * F.col("w") / weight))
    return ranked.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def _numbered():
    """Within a task, rows come ordered by source: numbers those of each source from 0."""
    state = {"source": object(), "next": 0}

    def each(batch: pa.RecordBatch):
        source = batch.column("source")
        codes = source.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
        at = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
        if source[0].as_py() == state["source"]:
            at[: first[1] if len(first) > 1 else None] += state["next"]
        state["source"], state["next"] = source[-1].as_py(), int(at[-1]) + 1
        task = np.full(len(source), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "row", "source", "size")), pa.array(task), pa.array(at)], ["key", "row", "source", "size", "task", "at"])

    return each


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Per input row: doc_id, source, size (words), source_size, target, copies, taken (copies * size). With ``row_col``, a number of each row, also row, which then orders rows of one id."""
    ship(docs.sparkSession)
    sized = count_words(docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.lit(0)).cast("bigint").alias("row")))
    ordered = sized.select("key", "row", "source", "size")
    # the texts are read once: sampling for the range bounds would else count the words again
    ordered = materialise(ordered, "mix-sizes")
    per_source = materialise(targets(ordered.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ordered.repartitionByRange(parts, "source", "size", "key", "row").sortWithinPartitions("source", "size", "key", "row")
    numbered = materialise(map_batches(sorted_, _numbered, "key bigint, row bigint, source string, size bigint, task int, at bigint"), "mix-order")
    runs = numbered.groupBy("task", "source").agg((F.max("at") + 1).alias("n"))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("task", F.col("source").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    per_source = per_source.withColumnRenamed("source", "t")
    # the first 32 bits of an MD5, as a fraction
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("t"), F.lit("null:")), F.lit(f":{seed}")).cast("binary")), 1, 8)
    offset = (F.conv(digits, 16, 10).cast("bigint") / float(1 << 32)).alias("offset")
    share = runs.join(per_source, F.col("s").eqNullSafe(F.col("t"))).select("task", "s", "base", "source_size", "target", "rate", offset)
    rank = F.col("base") + F.col("at")
    copies = F.floor((rank + 1) * F.col("rate") + F.col("offset")) - F.floor(rank * F.col("rate") + F.col("offset"))
    out = numbered.join(share.withColumnRenamed("task", "u"), (F.col("task") == F.col("u")) & F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), *(["row"] if row_col else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each row as often as it is taken, with their own columns. Rows that repeat an id are drawn one by one."""
    (copies, k) = fresh(docs, "copies", "row_number")
    numbered = materialise(docs.withColumn(k, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(numbered, id_col=id_col, row_col=k, **options).filter("copies > 0").select(F.col("row").alias(k), F.col("copies").alias(copies))
    joined = numbered.join(taken, k)
    (nth,) = fresh(joined, "nth")
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)

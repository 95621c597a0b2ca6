"""Exact deduplication by content, in DataFrame functions alone.

A row's key is the MD5 (128 bits) of its text without ASCII white space. The group-by holds the normalised bytes beside the
hash, so texts are compared in full and two that share an MD5 form two groups. Partial aggregation folds copies before the shuffle: a
group of any size sends at most one row per map task. A row finds its group again by the SHA-256 and the length of its bytes; should
two groups ever agree in both, the job stops instead of mixing them up.

Defined results: a null text counts as the empty one, and empty texts form a group of their own. A null id never stays if
another row can. Of rows that repeat an id and its text the verdicts are the same; ``distinct_documents`` keeps one of them. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, text_of, without_spaces
from textloom.operators.joins import splittable_join
from textloom.storage import materialise


def _whole(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(20,0)")


def _rank(length: Column, doc_id: Column) -> Column:
    """One decimal that orders rows by length, then by smaller id, null ids last. A mutable buffer keeps the aggregate hash-based."""
    inverse = F.coalesce(_whole(2**63) - doc_id.cast("decimal(20,0)"), _whole(0))
    return (length.cast("decimal(10,0)") * _whole(2**65) + inverse).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    rest = rank % _whole(2**65)
    return F.when(rest > 0, (_whole(2**63) - rest).cast("bigint"))


def _groups(rows: DataFrame, longest: bool) -> DataFrame:
    """One row per distinct normalised text: norm, rank, group_size. The key holds the bytes, so texts are compared in full, not by hash."""
    rank = _rank(F.col("n") if longest else F.lit(0), F.col("doc_id"))
    return rows.groupBy(F.md5(F.col("norm").cast("binary")).alias("h"), "norm").agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("group_size"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.char_length(text).alias("n"), without_spaces(text).alias("norm"))


def _found_by_digest(groups: DataFrame) -> DataFrame:
    """The groups by digest and length; the aggregate makes sure that there is one of each."""
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    one = groups.groupBy(digest.alias("text_sha256"), F.octet_length("norm").alias("bytes")).agg(F.max("rank").alias("rank"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    return one.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts of one length share a SHA-256")).cast("bigint"))).drop("texts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True) -> DataFrame:
    """One row per input row: doc_id, keep_id (the row that stays), group_size, kept, text_sha256.

    Of equal texts the longest original stays, then the smallest id; with ``longest=False`` the smallest id alone decides.
    """
    rows = _rows(docs, id_col, text_col)
    groups = _found_by_digest(_groups(rows, longest)).withColumn("keep_id", _id_of(F.col("rank")))
    found = rows.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("bytes"))
    found = splittable_join(found, groups, "text_sha256", "bytes")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True) -> DataFrame:
    """One row of each distinct text, the one that ``exact_dedup`` names, with its own columns.

    Rows are told apart by a number of their own, so rows that repeat an id, or have none, are judged one by one.
    """
    k, sha, size, rank = fresh(docs, "row_number", "text_sha256", "text_bytes", "text_rank")
    norm = without_spaces(text_of(text_col))
    own = {k: F.monotonically_increasing_id(), sha: F.sha2(norm.cast("binary"), 256), size: F.octet_length(norm), rank: _rank(F.char_length(text_of(text_col)) if longest else F.lit(0), F.col(id_col).cast("bigint"))}
    told = materialise(docs.withColumns(own), "exact-rows")
    best = _found_by_digest(_groups(_rows(told, id_col, text_col), longest)).select("text_sha256", "bytes", F.col("rank").alias("best"))
    ranked = told.select(F.col(k).alias("row"), F.col(sha).alias("text_sha256"), F.col(size).alias("bytes"), F.col(rank).alias("rank"))
    # of rows that rank alike, which have one id and length, the first stays
    first = splittable_join(ranked, best, "text_sha256", "bytes").filter("rank = best").groupBy("text_sha256", "bytes").agg(F.min("row").alias("first"))
    return told.join(first.select(F.col("first").alias(k)), k, "left_semi").select(*docs.columns)

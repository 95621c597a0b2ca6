"""Stored versions of a table with a tree of digests, so that two versions are compared where they differ and not elsewhere.

A version's rows lie in leaves, ranges of the key whose borders the first version sets and later ones keep. Each leaf has a digest that doesn't depend on the order of its rows: their number and two sums of
row hashes. Sixteen leaves make a node, sixteen nodes one of the next level, up to a root; a node's digest is the sum of its children's. Two versions are compared from the root down, below
differing nodes only, and only rows of leaves that differ are read and joined.

Defined results: rows without a key have a leaf of their own, the first. Rows that repeat a key lie in one leaf and count each. Two leaves are taken for equal only if both their 64-bit sums agree. Columns of
two versions may differ; then all leaves do.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import library
from textloom.operators.splits import mark
from textloom.session import ship
from textloom.storage import materialise

#: Leaves of a version, children of a node, and keys that the borders are taken from.
LEAVES, FAN, SAMPLE = 1024, 16, 100_000


def _leaf_of(rows: DataFrame, key: str, borders: list, name: str = "__leaf") -> DataFrame:
    """Adds the leaf of each row: 0 for null keys, else one more than the borders that are not above the key."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(borders)

    @F.pandas_udf("int")
    def leaf(keys):
        import pandas as pd

        bounds = sent.value
        return pd.Series([0 if k is None or k != k else 1 + bisect.bisect_right(bounds, k) for k in keys], dtype="int32")

    return rows.withColumn(name, leaf(F.col(key)))


@dataclass
class Version:
    """A stored version: its folder, key, borders and the columns of its rows. ``leaves_read`` tells of the last comparison."""

    spark: SparkSession
    path: str
    key: str
    borders: list
    schema: T.StructType
    leaves_read: int = 0

    @classmethod
    def save(cls, rows: DataFrame, path: str, key: str, like: Version | None = None, leaves: int = LEAVES) -> Version:
        """Writes a version below ``path``, which must not exist yet; ``like``, an older version, gives the borders, so that the two can be compared."""
        spark = rows.sparkSession
        kind = dict(rows.dtypes)[key]
        if kind not in ("string", "bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"keys must be strings or whole numbers, not {kind}")
        if like is None:
            keys = rows.select(key).filter(F.col(key).isNotNull())
            n = keys.count()
            if n > SAMPLE:
                keys = keys.filter(mark(key, 0) < int(SAMPLE / n * 2**60)).limit(2 * SAMPLE)
            known = sorted({r[0] for r in keys.collect()})
            step = max(1, -(-len(known) // leaves))
            borders = known[step::step]
        else:
            borders = like.borders
        spark.createDataFrame([(i, b) for i, b in enumerate(borders)], f"at int, border {kind}").coalesce(1).write.parquet(f"{path}/borders")
        spark.createDataFrame([(key, rows.schema.json())], "key string, schema string").coalesce(1).write.parquet(f"{path}/about")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = _leaf_of(rows, key, borders).repartitionByRange(parts, "__leaf", key)
        placed.write.partitionBy("__leaf").parquet(f"{path}/rows")
        version = cls(spark, path, key, borders, rows.schema)
        stored = version.rows()
        whole = F.to_json(F.struct(*sorted(stored.columns)), {"ignoreNullFields": "false"})
        sums = [F.sum(F.xxhash64(F.lit(salt), whole).cast("decimal(38,0)")).alias(name) for salt, name in ((1, "a"), (2, "b"))]
        level = materialise(version._stored().groupBy(F.col("__leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *sums), "digests")
        for k in range(version.height):
            level.withColumn("level", F.lit(k)).coalesce(1).write.mode("append").partitionBy("level").parquet(f"{path}/digests")
            level = level.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(*[F.sum(c).cast("decimal(38,0)" if c != "n" else "bigint").alias(c) for c in ("n", "a", "b")])
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Version:
        rows = spark.read.parquet(f"{path}/borders").orderBy("at").collect()  # one for each leaf
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark, path, about.key, [r.border for r in rows], T.StructType.fromJson(json.loads(about.schema)))

    @property
    def height(self) -> int:
        """Levels of the tree, the leaves included."""
        n, levels = len(self.borders) + 2, 1
        while n > 1:
            n, levels = -(-n // FAN), levels + 1
        return levels

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__leaf", T.IntegerType())])).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._stored().drop("__leaf")

    def _some(self, leaves: list[int]) -> DataFrame:
        """The rows of some leaves; no other folder is opened."""
        stored = self._stored()
        there = [k for k in leaves if k in self._sizes()]
        if not there:
            return stored.limit(0).drop("__leaf")
        read = self.spark.read.schema(stored.schema).option("basePath", f"{self.path}/rows")
        return read.parquet(*[f"{self.path}/rows/__leaf={k}" for k in there]).drop("__leaf")

    def _digests(self, level: int, parents: list[int] | None) -> dict[int, tuple]:
        rows = self.spark.read.schema("node int, n bigint, a decimal(38,0), b decimal(38,0), level int").parquet(f"{self.path}/digests").filter(F.col("level") == level)
        if parents is not None:
            rows = rows.filter(F.floor(F.col("node") / FAN).isin(parents))
        return {r.node: (r.n, r.a, r.b) for r in rows.collect()}  # at most the children of nodes that differ

    def _sizes(self) -> dict[int, int]:
        return {node: n for node, (n, _, _) in self._digests(0, None).items()}

    def differing(self, other: Version) -> list[int]:
        """The leaves in which two versions differ, found from the root down."""
        if self.borders != other.borders:
            raise ValueError("these versions have different borders: save one like the other")
        if sorted(self.rows().dtypes) != sorted(other.rows().dtypes):
            return sorted({*self._sizes(), *other._sizes()})
        nodes: list[int] | None = None
        for level in range(self.height - 1, -1, -1):
            a, b = self._digests(level, nodes), other._digests(level, nodes)
            nodes = sorted(k for k in {*a, *b} if a.get(k) != b.get(k))
            if not nodes:
                return []
        return nodes

    def _both(self, other: Version) -> tuple[DataFrame, DataFrame, list[int]]:
        leaves = self.differing(other)
        self.leaves_read = len(leaves)
        return self._some(leaves), other._some(leaves), leaves

    def difference(self, other: Version) -> DataFrame:
        """Keys that only one of two versions has, and which: "a" for this one. As ``library.part_difference`` of all rows."""
        a, b, _ = self._both(other)
        return library.part_difference(a, b, self.key)

    def changed(self, other: Version) -> DataFrame:
        """Keys whose rows aren't the same in both versions: key, change ("added", "removed", "changed") as seen from ``other``, the older."""
        a, b, _ = self._both(other)
        told = lambda df, n: df.select(self.key, F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("h")).groupBy(self.key).agg(F.count(F.lit(1)).alias(f"n{n}"), F.sum(F.col("h").cast("decimal(38,0)")).alias(f"h{n}"))
        x, y = told(a, 1), told(b, 2).withColumnRenamed(self.key, "__key")
        both = x.join(y, x[self.key].eqNullSafe(y["__key"]), "full_outer").filter(~(F.col("n1").eqNullSafe(F.col("n2")) & F.col("h1").eqNullSafe(F.col("h2"))))
        change = F.when(F.col("n2").isNull(), "added").when(F.col("n1").isNull(), "removed").otherwise("changed")
        return both.select(F.coalesce(self.key, "__key").alias(self.key), change.alias("change"))

    def merged(self, other: Version) -> DataFrame:
        """This version's rows, each missing value filled from the older version's row of the same key, which must be one. As ``library.merge_versions`` of all rows, but rows of equal leaves, which have nothing to gain, aren't joined."""
        leaves = sorted({0, *self.differing(other)})  # rows without a key have no partner even in an equal leaf
        self.leaves_read = len(leaves)
        joined = library.merge_versions(self._some(leaves), other._some(leaves), self.key)
        rest = self._some(sorted({*self._sizes()} - {*leaves}))
        return joined.unionByName(rest.select(*joined.columns))

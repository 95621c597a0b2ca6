"""Shuffles, samples, splits and unions. All are decided by hashes of a key, so they don't depend on how rows are laid out."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.units import numbered
from textloom.storage import materialise


def mark(key: str, seed: int) -> Column:
    """A number of 60 bits from a key and a seed: the first digits of an MD5, so that other engines can tell it too."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("bigint")


ROUNDS = 4
#: A position leaves the wanted range with a chance of two in its root, so so many steps never are needed.
STEPS = 64


def _drawn(value: Column, seed: str, turn: int) -> Column:
    """32 bits from a number, a seed and the number of a round."""
    return F.conv(F.substring(F.md5(F.concat(value.cast("string"), F.lit(f":{seed}:{turn}")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _sides(n: int) -> tuple[int, int]:
    """Two factors whose product is n or a little more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(position: Column, n: int, seed: int = 42, epoch: int = 0, back: bool = False) -> Column:
    """Where a position from 0 to n - 1 goes in the shuffle of an epoch, or with ``back`` what comes to it. It is computed, not sorted: a bijection of these numbers.

    A number is a pair of digits; in turn each is moved by a hash of the other, which can be undone. The pairs are a few more than n, and a number that lands beyond goes on until it is inside.
    """
    a, b = _sides(n)
    seed_ = f"{seed}:{epoch}"

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).alias("r"))
        sign = -1 if back else 1
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            pair = _turned(pair, turn, sign)
        return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]

    def _turned(pair: Column, turn: int, sign: int) -> Column:
        # a lambda, so that what went before is computed once
        def move(p: Column) -> Column:
            if turn % 2 == 0:
                return F.struct(F.pmod(p["l"] + sign * _drawn(p["r"], seed_, turn), F.lit(a)).alias("l"), p["r"].alias("r"))
            return F.struct(p["l"].alias("l"), F.pmod(p["r"] + sign * _drawn(p["l"], seed_, turn), F.lit(b)).alias("r"))

        return F.transform(F.array(pair), move)[0]

    x = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once(position.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(x < n, x).otherwise(F.raise_error(F.lit("a position didn't come back into range")).cast("bigint"))


def shuffled(rows: DataFrame, *order: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds position: each row's place in the shuffle of an epoch. Rows are numbered in the given order once; epochs differ by the permutation alone, and nothing is sorted by it."""
    at = materialise(numbered(rows, *order, name="__at"), "shuffled")
    n = at.count()
    return at.withColumn("position", permuted(F.col("__at"), n, seed, epoch)).drop("__at")


def shuffled_from(rows: DataFrame, *order: str, start: int, count: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """The rows at positions start to start + count of the same shuffle, to resume an epoch: the wanted numbers are computed from their positions and joined."""
    at = materialise(numbered(rows, *order, name="__at"), "shuffled")
    n = at.count()
    wanted = at.sparkSession.range(min(start, n), min(start + count, n)).select(F.col("id").alias("position"), permuted(F.col("id"), n, seed, epoch, back=True).alias("__at"))
    return at.join(wanted, "__at").drop("__at")


def fraction(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """The first int(n * share) rows of the shuffle. The rows are numbered in its order, so none are gathered in one task."""
    h = "__shuffle"
    n = rows.agg(F.floor(F.count(F.lit(1)) * share).alias("__least"))
    at = numbered(rows.withColumn(h, mark(key, seed)), h, key, name="__at")
    return at.join(F.broadcast(n), F.col("__at") < F.col("__least")).drop(h, "__at", "__least")


def train_test(rows: DataFrame, key: str, tenths: int = 1, seed: int = 0) -> DataFrame:
    """Adds split: "eval" for about tenths / 10 of the keys, "train" for the rest."""
    h = mark(key, seed) % 10
    return rows.withColumn("split", F.when(h < tenths, F.lit("eval")).otherwise(F.lit("train")))


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def corpus_gib(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.agg((F.sum(F.length(text_col)) / F.pow(F.lit(1024.0), 3)).alias("gib"))

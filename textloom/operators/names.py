"""Which names stand in which texts, as whole identifiers: an index of identifiers and an equi-join, not each text with each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.joins import splittable_join

#: What identifiers are made of, and begin with.
INSIDE, BEGIN = "A-Za-z0-9_$", "A-Za-z_$"


def identifiers(c: Column | str) -> Column:
    """The distinct identifiers of a text: runs of letters, digits, _ and $ that don't begin with a digit."""
    return F.array_distinct(F.filter(F.split(X.col(c), f"[^{INSIDE}]+"), lambda x: x.rlike(f"^[{BEGIN}]")))


def stands_whole(text: Column, part: Column) -> Column:
    """Whether a text holds a part that begins and ends where no identifier goes on."""
    quoted = F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(part.rlike(f"^[{INSIDE}]"), F.lit(f"(?<![{INSIDE}])")).otherwise("")
    after = F.when(part.rlike(f"[{INSIDE}]$"), F.lit(f"(?![{INSIDE}])")).otherwise("")
    return F.contains(text, part) & F.rlike(text, F.concat(before, quoted, after))


def _longest(found: Column) -> Column:
    """The longest of some identifiers, the first of equal ones; null without any."""
    return F.aggregate(found, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


#: Slots of the filters of wanted identifiers: of all texts, and of one file.
SLOTS, FILE_SLOTS = 1 << 20, 1 << 12


def _slot(c: Column | str, slots: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")


def mentions(texts: DataFrame, names: DataFrame, on: str, *keys: str, text: str = "text", name: str = "name") -> DataFrame:
    """The distinct (on, keys, name) for names that stand in a text with the same ``on``; ``on`` and ``keys`` tell the texts apart.

    Names meet texts by their longest identifier; identifiers of which a filter tells that no name has them are not shuffled. A name that is more than one identifier is then looked for in the texts that it met. Null
    texts hold nothing; names without an identifier, and null ones, stand nowhere.
    """
    found = texts.select(on, *keys, F.explode(identifiers(text)).alias("__found"))
    wanted = names.select(on, F.col(name).alias("__name")).distinct().withColumn("__found", _longest(identifiers("__name"))).filter("__found is not null")
    some = wanted.select(_slot("__found", SLOTS).alias("__slot")).distinct()  # at most SLOTS rows
    found = found.withColumn("__slot", _slot("__found", SLOTS)).join(F.broadcast(some), "__slot", "left_semi").drop("__slot")
    met = found.distinct().join(wanted, [on, "__found"])
    plain = F.col("__name") == F.col("__found")
    more = met.filter(~plain).select(on, *keys, "__name").join(texts.select(on, *keys, F.col(text).alias("__text")), [on, *keys])
    more = more.filter(stands_whole(F.col("__text"), F.col("__name"))).select(on, *keys, "__name")
    return met.filter(plain).select(on, *keys, "__name").union(more).distinct().withColumnRenamed("__name", name)


def first_lines(snippets: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """The first line (file, line_number, content) that holds each snippet (file, keys, snippet) whole: file, keys, line_number.

    A snippet meets lines by that of its identifiers which the fewest lines of the file have. Snippets of punctuation alone are compared with all lines of their file.
    """
    asked = snippets.select("file", *keys, "snippet").distinct()
    # lines meet a filter of what the snippets of their file ask for, so that other identifiers are not shuffled
    wanted = asked.select("file", F.explode(identifiers("snippet")).alias("__found")).select("file", _slot("__found", FILE_SLOTS).alias("__slot")).distinct()
    wanted = wanted.groupBy("file").agg(F.collect_list("__slot").alias("__slots"))  # at most FILE_SLOTS each
    rows = splittable_join(lines.select("file", "line_number", "content"), wanted, "file")
    known = F.filter(identifiers("content"), lambda x: F.array_contains(F.col("__slots"), _slot(x, FILE_SLOTS)))
    found = rows.select("file", "line_number", F.explode(known).alias("__found"))
    often = found.groupBy("file", "__found").agg(F.count(F.lit(1)).alias("__n"))
    each = asked.select("*", F.explode(identifiers("snippet")).alias("__found")).join(often, ["file", "__found"], "left")
    rarest = each.groupBy("file", *keys, "snippet").agg(F.min_by("__found", F.struct(F.coalesce("__n", F.lit(0)), "__found")).alias("__found"))
    met = rarest.join(found, ["file", "__found"]).drop("__found").join(lines.select("file", "line_number", "content"), ["file", "line_number"])
    bare = asked.filter(F.size(identifiers("snippet")) == 0).join(lines.select("file", "line_number", "content"), "file")
    columns = ["file", *keys, "line_number"]
    hits = met.filter(stands_whole(F.col("content"), F.col("snippet"))).select(*columns).union(bare.filter(F.contains("content", "snippet")).select(*columns))
    return hits.groupBy("file", *keys).agg(F.min("line_number").alias("line_number"))

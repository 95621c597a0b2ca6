"""Code units as rows. The line rules run in Arrow batches, one call per file; everything around them is relational."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import code_text as C
from textloom.functions import text as X
from textloom.operators.joins import splittable_join
from textloom.operators.names import mentions
from textloom.session import ship

UNIT = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType())]))
SPLIT = T.StructType([T.StructField("units", UNIT), T.StructField("outside", T.StringType())])


def on_text(f: Callable[[str], object], returns) -> Callable[[Column], Column]:
    """A function of one text as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(returns)
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    def apply(c: Column | str) -> Column:
        ship()
        return run(X.col(c).cast("string"))

    return apply


def _rows(units: list[C.Unit]) -> list[dict]:
    return [{"name": u.name, "text": u.text, "line_start": u.start, "line_end": u.end} for u in units]


def _split(f):
    def run(texts):
        import pandas as pd

        found = [([], None) if t is None else f(t) for t in texts]
        return pd.DataFrame({"units": [_rows(u) for u, _ in found], "outside": [o for _, o in found]})

    ship()
    return F.pandas_udf(run, SPLIT)


def split_modules(c: Column | str) -> Column:
    """Struct of the modules of a file (name, text, lines) and the text outside them."""
    return _split(C.split_modules)(X.col(c).cast("string"))


def split_functions(c: Column | str) -> Column:
    return _split(C.split_functions)(X.col(c).cast("string"))


def function_files(c: Column | str) -> Column:
    """Functions with the declarations they use."""
    return on_text(lambda t: _rows(C.function_files(t)), UNIT)(c)


def header_lines(c: Column | str) -> Column:
    return on_text(lambda t: C.headers(C.split_functions(t)[1]), "array<string>")(c)


def variable_lines(c: Column | str) -> Column:
    return on_text(lambda t: C.variables(C.split_functions(t)[1]), "array<string>")(c)


def array_blocks(c: Column | str) -> Column:
    return on_text(lambda t: C.arrays(C.split_functions(t)[1]), "array<string>")(c)


def remove_comment_lines(c: Column | str, compat: bool = False) -> Column:
    return on_text(lambda t: C.remove_comment_lines(t, compat), "string")(c)


def keep_module_lines(c: Column | str) -> Column:
    return on_text(C.keep_module_lines, "string")(c)


def is_valid_module(c: Column | str, compat: bool = False) -> Column:
    return on_text(lambda t: C.is_valid_module(t, compat), "boolean")(c)


def tidy(c: Column | str, discard_comments: bool = True, modules: bool = True) -> Column:
    return on_text(lambda t: C.tidy(t, discard_comments, modules), "string")(c)


def _string(f: Callable[[str], str]) -> Callable[[Column | str], Column]:
    def apply(c: Column | str) -> Column:
        return on_text(f, "string")(c)

    return apply


join_semicolons = _string(C.join_semicolons)
join_brackets = _string(C.join_brackets)
join_parentheses = _string(C.join_parentheses)
join_module_word = _string(C.join_module_word)
join_parameters = _string(C.join_parameters)
normalise_modules = _string(C.normalise_modules)
normalise_functions = _string(C.normalise_functions)


def module_rows(corpus: DataFrame, id_col: str = "task_id", text_col: str = "text") -> DataFrame:
    """One row per module of each file, each with what its file has outside modules: source_id, nth, n_modules, module_name, text, code_str_before_preprocessing.

    Files without a module give no row.
    """
    s = corpus.select(F.col(id_col).alias("source_id"), F.col(text_col).alias("whole"), split_modules(text_col).alias("s"))
    rows = s.select("source_id", "whole", F.size("s.units").alias("n_modules"), F.col("s.outside").alias("outside"), F.posexplode("s.units").alias("nth", "u"))
    return rows.select("source_id", "nth", "n_modules", F.col("u.name").alias("module_name"), F.concat_ws("\n", "outside", "u.text").alias("text"), F.col("whole").alias("code_str_before_preprocessing"))


def numbered(rows: DataFrame, *order: str, name: str = "task_id", parts: int | None = None) -> DataFrame:
    """A running number from 0 in the given order, without moving all rows to one task.

    A range shuffle orders the rows and each task numbers its own as it writes them; only one count per task is summed centrally.
    """
    from textloom.storage import materialise

    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "numbered")
    task = F.shiftright("__id", 33)  # the id is the task's number, and below 33 bits the row's
    counts = ranged.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # a row for each task
    out = ranged.withColumn("__task", task).join(F.broadcast(base), "__task")
    return out.withColumn(name, (F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("__task", "__id", "__base")


def numbered_within(rows: DataFrame, key: str, *order: str, name: str) -> DataFrame:
    """A running number from 0 for the rows of each key; a key's rows may lie in many tasks."""
    at = numbered(rows, key, *order, name="__at")
    first = at.groupBy(key).agg(F.min("__at").alias("__first"))
    return splittable_join(at, first, key).withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first")


def separated(corpus: DataFrame, id_col: str = "task_id", text_col: str = "text") -> DataFrame:
    """The corpus of modules with a running task_id: text, module_name, task_id, code_str_before_preprocessing."""
    return numbered(module_rows(corpus, id_col, text_col), "source_id", "nth").select("text", "module_name", "task_id", "code_str_before_preprocessing")


def used_symbols(functions: DataFrame, declarations: DataFrame, compat: bool = False) -> DataFrame:
    """Declarations whose name a function of the same file uses: functions (file, function_name, text) and declarations (file, symbol, declaration).

    A name must stand as a whole; with ``compat`` it may be a part of another, and every function meets every declaration of its file.
    """
    if compat:
        joined = functions.join(declarations, "file").filter(F.contains("text", "symbol"))
    else:
        told = functions.withColumn("__h", F.xxhash64("text"))
        joined = mentions(told, declarations, "file", "function_name", "__h", name="symbol").select("file", "function_name", "symbol").distinct().join(declarations, ["file", "symbol"])
    return joined.groupBy("file", "function_name").agg(F.array_sort(F.collect_list("declaration")).alias("used"))


def outside_lines(lines: DataFrame, units: DataFrame) -> DataFrame:
    """Lines (file, line_number, content) that no unit (file, line_start, line_end) covers, joined again per file."""
    covered = units.select(F.col("file"), F.explode(F.sequence("line_start", "line_end")).alias("line_number"))
    left = lines.join(covered, ["file", "line_number"], "left_anti")
    return left.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda x: x["content"]), "\n").alias("outside"))

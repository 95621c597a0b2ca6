"""Scans. Every reader goes through Spark's own sources, so paths may lie in any store that the cluster reads."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources import schemas

#: File endings by language.
SUFFIXES = {"verilog": ("v", "sv", "vh"), "hls": ("c", "cpp", "h", "hpp")}


#: Where writers put what belongs to many files together.
PACKED = "layout=packed"


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset (a folder of Parquet files)."""
    return spark.read.parquet(path)


def _name() -> Column:
    return F.col("_metadata.file_name")


def flat_directory(spark: SparkSession, path: str) -> DataFrame:
    """Files of one folder, whole: task_id (position in order of name, as a string), text, file."""
    from textloom.operators.units import numbered

    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), _name().alias("file"))
    return numbered(rows, "file").select(F.col("task_id").cast("string").alias("task_id"), "text", "file")


def code_tree(spark: SparkSession, path: str, language: str = "verilog", sidecars: bool = True) -> DataFrame:
    """Code files below a folder: file, name (stem), genre (folders joined by ", "), text, and the text beside it (<stem>.txt) or null. They are files of their own, or what ``writers.documented_package`` packed."""
    packed = _packed_tree(spark, path, language)
    rows = _file_tree(spark, path, language, sidecars)
    return rows if packed is None else rows.unionByName(packed if sidecars else packed.drop("sidecar"))


def _packed_tree(spark: SparkSession, path: str, language: str) -> DataFrame | None:
    try:
        rows = spark.read.schema("file string, text string, sidecar string").parquet(f"{path.rstrip('/')}/{PACKED}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    folders, file = F.split("file", "/"), F.element_at(F.split("file", "/"), -1)
    genre = F.array_join(F.slice(folders, F.lit(1), F.size(folders) - 1), ", ")
    place = F.concat(F.lit(path.rstrip("/") + "/"), "file")
    return with_suffix(rows, language).select(place.alias("path"), file.alias("file"), X.stem(file).alias("name"), genre.alias("genre"), "text", "sidecar")


def _file_tree(spark: SparkSession, path: str, language: str, sidecars: bool) -> DataFrame:
    glob = "*.{" + ",".join(SUFFIXES[language]) + "}"
    read = lambda g: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", g).load(path)
    place = F.element_at(F.split(F.col("path"), F.lit("/" + path.rstrip("/").rpartition("/")[2] + "/"), 2), -1)
    file = lambda: F.element_at(F.split(place, "/"), -1)
    folders = F.split(place, "/")
    rows = read(glob).select("path", file().alias("file"), X.stem(file()).alias("name"), F.array_join(F.slice(folders, F.lit(1), F.size(folders) - 1), ", ").alias("genre"), F.decode("content", "UTF-8").alias("text"))
    if not sidecars:
        return rows
    folder = lambda: F.regexp_replace("path", "/[^/]*$", "")
    beside = read("*.txt").select(folder().alias("__d"), X.stem(file()).alias("__n"), F.decode("content", "UTF-8").alias("sidecar"))
    return rows.withColumn("__d", folder()).join(beside.withColumnRenamed("__n", "name"), ["__d", "name"], "left").drop("__d")


def with_suffix(rows: DataFrame, language: str, file_col: str = "file") -> DataFrame:
    return rows.filter(F.col(file_col).rlike(r"\.(" + "|".join(SUFFIXES[language]) + ")$"))


def _reader(spark: SparkSession, schema: str | None, damaged: str | None, **options):
    """A reader of rows in text form. With ``damaged``, a column of that name holds the whole row where it can't be read, and is null elsewhere."""
    reader = spark.read.options(**options)
    if damaged:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", damaged)
    if schema:
        reader = reader.schema(f"{schema}, `{damaged}` STRING" if damaged else schema)
    return reader


#: Fields may hold line breaks and quotes, which are doubled; a field without quotes that is empty is null, an empty one in quotes is not.
CSV = {"header": True, "multiLine": True, "escape": '"', "nullValue": "\x00"}


def json_lines(spark: SparkSession, path: str, schema: str, damaged: str | None = None) -> DataFrame:
    """JSON lines, plain or compressed; blank lines are skipped. Lines that aren't JSON give nulls, and stand in the column ``damaged`` if that is named."""
    return _reader(spark, schema, damaged).json(path)


def problems(spark: SparkSession, path: str) -> DataFrame:
    """One row per task; of repeated tasks the last line counts."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    parsed = rows.filter(F.trim("value") != "").select(F.from_json("value", schemas.PROBLEMS).alias("s"), F.struct("p", "b", "at").alias("o"))
    return parsed.groupBy("s.task_id").agg(F.max_by("s", "o").alias("s")).select("s.*")


def json_map(spark: SparkSession, path: str, value_schema: str = schemas.METADATA_MAP, key: str = "task_id") -> DataFrame:
    """JSON objects keyed by id: one row per key. A file is one object, or has an object in each line, as its first line tells; the latter is read line by line."""
    where = F.col("_metadata.file_path").alias("p")
    rows = spark.read.text(path).select("value", where, F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("at"))
    first = rows.filter("s = 0 and trim(value) <> ''").groupBy("p").agg(F.min_by("value", "at").alias("v"))
    first = first.select("p", F.expr("coalesce(schema_of_variant(try_parse_json(v)) like 'OBJECT%', false)").alias("lines"))
    counts = {r.lines: r["count"] for r in first.groupBy("lines").count().collect()}
    read = lambda whole: spark.read.text(path, wholetext=whole).select("value", where)
    if len(counts) < 2:
        rows = read(not counts.get(True))
    else:  # names of files, of which Spark knows all in any case
        few = counts[True] < counts[False]
        named = [r.p for r in first.filter(F.col("lines") == few).select("p").collect()]
        rows = read(not few).filter(F.col("p").isin(named)).union(read(few).filter(~F.col("p").isin(named)))
    return rows.select(F.explode(F.from_json("value", value_schema)).alias(key, "s")).select(key, "s.*")


def _decoded(c: Column) -> Column:
    """Without the %xx of a path; a plus is a plus."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def csv_lines(spark: SparkSession, path: str, schema: str = schemas.CSV_LINES, damaged: str | None = None) -> DataFrame:
    """Line tables in CSV: what ``writers.csv_lines`` writes, packed or in a folder file=<name>, or a file <name>.csv for each file, with its name in ``file``; the word for no comment becomes null.

    Folders stand for null and empty names alike, which come back as null.
    """
    where = F.col("_metadata.file_path")
    rows = _reader(spark, schema, damaged, **CSV, recursiveFileLookup=True).csv(path).select("*", where.alias("__path")).filter(~F.contains("__path", F.lit(f"/{PACKED}/")))
    # the path is encoded once as such, and the folder's name once more by the writer
    folder = _decoded(_decoded(F.regexp_extract("__path", "/file=([^/]*)/[^/]*$", 1)))
    name = F.regexp_replace(_decoded(F.regexp_extract("__path", "([^/]*)$", 1)), r"\.csv$", "")
    file = F.when(F.col("__path").rlike("/file=[^/]*/[^/]*$"), F.when(folder != "__HIVE_DEFAULT_PARTITION__", folder)).otherwise(name)
    content = F.when(F.col("content") != X.NO_COMMENT, F.col("content"))
    rows = rows.withColumns({"file": file, "content": content}).drop("__path")
    if path.endswith(".csv"):
        return rows
    try:
        packed = _reader(spark, f"{schema}, file STRING", damaged, **CSV).csv(f"{path.rstrip('/')}/{PACKED}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    return rows.unionByName(packed.withColumn("content", content))


def embeddings_csv(spark: SparkSession, path: str, damaged: str | None = None) -> DataFrame:
    """Embeddings written as text lists."""
    raw = _reader(spark, "Filename STRING, embedding STRING, Line_id INT, Text STRING", damaged, **CSV).csv(path)
    return raw.withColumn("embedding", F.from_json("embedding", "ARRAY<DOUBLE>"))


def _in_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line of a JSON file is an object of its own; else a file is one document."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    try:
        return not first or isinstance(json.loads(first[0].value), dict)
    except ValueError:
        return False


def by_format(spark: SparkSession, path: str, schema: str | None = None, damaged: str | None = None) -> DataFrame:
    """A local dataset by its ending: json (objects in lines, or a document with one or a list of them), jsonl, csv, tsv or parquet.

    With ``damaged``, rows in text form that can't be read stand in a column of that name.
    """
    end = path.rpartition(".")[2]
    if end in ("json", "jsonl"):
        return _reader(spark, schema, damaged, multiLine=end == "json" and not _in_lines(spark, path)).json(path)
    if end in ("csv", "tsv"):
        return _reader(spark, schema, damaged, **CSV, sep="\t" if end == "tsv" else ",").csv(path)
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {end}")


def system_context(spark: SparkSession, path: str, skip: tuple[str, ...] = ("fixed_feature", "converse_samples")) -> DataFrame:
    """Lines of the text files of a folder: Filename, Filetype, Summary, Text, Line_id."""
    whole = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("value"), _name().alias("Filename"))
    for s in skip:
        whole = whole.filter(~F.contains("Filename", F.lit(s)))
    rows = whole.select("Filename", X.stem("Filename").alias("Filetype"), F.lit("1").alias("Summary"), F.posexplode(X.py_splitlines("value")).alias("Line_id", "Text"))
    return rows.select("Filename", "Filetype", "Summary", "Text", "Line_id")


class Registry:
    """Named datasets: a name leads to a path and to the format of its rows."""

    def __init__(self, places: dict[str, tuple[str, str]]):
        self.places = places

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        from textloom.operators.pairs import formatted

        path, kind = self.places[name]
        return formatted(by_format(spark, path), kind)

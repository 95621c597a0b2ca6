"""Line tables: (file, line_number, content), 0-based, one table for all files. Windows run within a file."""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import alignment, splitting, word_runs
from textloom.functions import text as X
from textloom.functions.memory import tidy
from textloom.operators.names import first_lines
from textloom.session import ship
from textloom.storage import materialise


def ordered_concat(order: str, value: str | Column, sep: str) -> Column:
    """The values of a group, joined in order."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda x: x["v"]), sep)


def line_table(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    return files.select(F.col(file_col).alias("file"), F.posexplode(X.lines(text_col)).alias("line_number", "content"))


def whole_texts(lines: DataFrame, sep: str = "\n") -> DataFrame:
    return lines.groupBy("file").agg(ordered_concat("line_number", "content", sep).alias("text"))


def group_lines(lines: DataFrame, sep: str = " ") -> DataFrame:
    """Rows of one line number joined in the order of ``at``: (file, line_number, at, content)."""
    return lines.groupBy("file", "line_number").agg(ordered_concat("at", "content", sep).alias("content"))


def align_comments(lines: DataFrame, is_comment: Column) -> tuple[DataFrame, DataFrame]:
    """Code lines numbered anew, and for each the comment lines right before it (null without any).

    Comment lines belong to the next code line; their number is the count of code lines before them. Comments after the last code line go.
    """
    before = Window.partitionBy("file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    told = lines.withColumn("comment", is_comment)
    told = told.withColumn("n", F.coalesce(F.sum((~F.col("comment")).cast("int")).over(before), F.lit(0)).cast("int"))
    code = told.filter(~F.col("comment")).select("file", F.col("n").alias("line_number"), "content")
    text = told.filter("comment").groupBy("file", "n").agg(ordered_concat("line_number", F.concat("content", F.lit("\n")), " ").alias("note"))
    comments = code.select("file", "line_number").join(text.withColumnRenamed("n", "line_number"), ["file", "line_number"], "left")
    return code, comments.withColumnRenamed("note", "content")


def interleave(code: DataFrame, comments: DataFrame) -> DataFrame:
    """Each file's text with the comments above their lines; every code line ends in a newline."""
    both = code.join(comments.select("file", "line_number", F.col("content").alias("note")), ["file", "line_number"], "left")
    line = F.concat(F.coalesce("note", F.lit("")), F.col("content"), F.lit("\n"))
    return both.groupBy("file").agg(ordered_concat("line_number", line, "").alias("text"))


def lines_between(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last (inclusive); what is outside a file is clamped away."""
    return lines.filter(F.col("line_number").between(first, last))


def lines_at(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return lines.join(wanted.select("file", "line_number").distinct(), ["file", "line_number"], "left_semi")


def context(lines: DataFrame, before: int = 15, after: int = 15) -> DataFrame:
    """For each line the numbered lines around it, as two texts."""
    w = Window.partitionBy("file").orderBy("line_number")
    line = F.concat(F.col("line_number").cast("string"), F.lit(": "), F.col("content"))
    return lines.withColumn("above", F.array_join(F.collect_list(line).over(w.rowsBetween(-before, -1)), "\n")).withColumn("below", F.array_join(F.collect_list(line).over(w.rowsBetween(1, after)), "\n"))


def batches(lines: DataFrame, size: int = 5, start: int = 0) -> DataFrame:
    """Consecutive lines in batches of ``size``: file, batch, first_line, last_line, text."""
    b = lines.filter(F.col("line_number") >= start).withColumn("batch", F.floor((F.col("line_number") - start) / size).cast("int"))
    return b.groupBy("file", "batch").agg(F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), ordered_concat("line_number", "content", "\n").alias("text"))


def chunks(code: DataFrame, comments: DataFrame, size: int = 10) -> DataFrame:
    """Chunks of ``size`` code lines below the module header, with their comments: file, chunk_idx, page_content, splitted_idx.

    The header ends on the first line with a semicolon; a file without one is chunked from its first line.
    """
    head = code.filter(F.contains("content", F.lit(";"))).groupBy("file").agg((F.min("line_number") + 1).alias("start"))
    body = code.join(head, "file", "left").withColumn("start", F.coalesce("start", F.lit(0))).filter("line_number >= start").withColumn("at", F.col("line_number") - F.col("start"))
    body = body.join(comments.select("file", "line_number", F.col("content").alias("note")), ["file", "line_number"], "left")
    line = F.concat(F.coalesce("note", F.lit("")), F.col("content"), F.lit("\n"))
    grouped = body.withColumn("chunk_idx", F.floor(F.col("at") / size).cast("int")).groupBy("file", "chunk_idx")
    return grouped.agg(ordered_concat("at", line, "").alias("page_content"), F.array_sort(F.collect_list(F.col("at").cast("int"))).alias("splitted_idx"))


def text_chunks(files: DataFrame, size: int = 10, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """The text below the header, in chunks of ``size`` lines."""
    body = line_table(files.withColumn("__body", X.body_after_header(text_col)), file_col, "__body")
    return batches(body, size).select("file", F.col("batch").alias("chunk_idx"), F.col("text").alias("page_content"))


def char_chunks(rows: DataFrame, key: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters that overlap: key, chunk_idx, chunk."""
    return rows.select(key, F.posexplode(_windows(F.col(text_col), size, overlap)).alias("chunk_idx", "chunk"))


def _windows(text: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _at_borders(rows: DataFrame, text_col: str, size: int, overlap: int, idx: str, chunk: str, whole: bool = False) -> DataFrame:
    """The rows with each of their chunks: the other columns, with ``whole`` the text too, idx, chunk. A task cuts about a megabyte of text at a time."""
    kept = [c for c in rows.columns if whole or c != text_col]
    kinds = dict(rows.dtypes)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, texts in word_runs.pieces(b.column(text_col), 1 << 20):
                cut = [splitting.chunks(t, size, overlap) for t in texts.to_pylist()]
                of = pa.array([at + i for i, c in enumerate(cut) for _ in c], pa.int64())
                nth, found = pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([x for c in cut for x in c], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in kept), nth, found], [*kept, idx, chunk])
        tidy()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{idx}` int", f"`{chunk}` string"]))


def bordered_chunks(rows: DataFrame, key: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Chunks of up to ``size`` characters that end at paragraphs, lines or words where they can: key, chunk_idx, chunk."""
    return _at_borders(rows.select(key, F.col(text_col).alias("__text")), "__text", size, overlap, "chunk_idx", "chunk")


def parent_chunks(rows: DataFrame, key: str, text_col: str, large: tuple[int, int] = (400, 100), small: tuple[int, int] = (100, 30), borders: bool = True) -> DataFrame:
    """Small chunks with the large chunk that each belongs to: key, large_idx, small_idx, large, small. Without ``borders`` they are windows of so many characters."""
    if borders:
        big = _at_borders(rows.select(key, F.col(text_col).alias("__text")), "__text", *large, "large_idx", "large")
        return _at_borders(big, "large", *small, "small_idx", "small", whole=True).select(key, "large_idx", "large", "small_idx", "small")
    big = rows.select(key, F.posexplode(_windows(F.col(text_col), *large)).alias("large_idx", "large"))
    return big.select(key, "large_idx", "large", F.posexplode(_windows(F.col("large"), *small)).alias("small_idx", "small"))


def running_history(blocks: DataFrame, summarise=None) -> DataFrame:
    """For each block (file, block, code[, summary]) the text of all blocks before it and their summaries.

    Given ``summarise(history, code)``, summaries come from it one after the other, as each prompt holds the last ones; files stay independent.
    """
    if summarise is None:
        w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        said = F.concat(F.col("code"), F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
        return blocks.withColumn("history", F.array_join(F.collect_list(said).over(w), ""))

    def run(pdf):
        pdf = pdf.sort_values("block").reset_index(drop=True)
        history, summaries, histories = "", [], []
        for code in pdf["code"]:
            histories.append(history)
            summaries.append(summarise(history, code))
            history += f"{code}\n{summaries[-1]}\n"
        return pdf.assign(summary=summaries, history=histories)[["file", "block", "code", "summary", "history"]]

    return blocks.select("file", "block", "code").groupBy("file").applyInPandas(run, "file string, block int, code string, summary string, history string")


def memory(turns: DataFrame, exchanges: int = 2, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last exchanges before each turn, as one text."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-2 * exchanges, -1)
    said = F.concat("role", F.lit(": "), "text")
    return turns.withColumn("memory", F.array_join(F.collect_list(said).over(w), "\n"))


def ring(items: Column, n: int = 5) -> Column:
    """The last n items of an array."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def latest(turns: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    return turns.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def count_mismatches(**tables: DataFrame) -> DataFrame:
    """Files whose tables differ in their number of lines."""
    out = None
    for name, t in tables.items():
        n = t.groupBy("file").agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, "file", "full_outer")
    first, *rest = tables
    differs = F.lit(False)
    for r in rest:
        differs = differs | ~F.col(first).eqNullSafe(F.col(r))
    return out.filter(differs)


def _walked(code: list[str], comments: list[str | None], corrected: list[str], most: int | None) -> tuple[list[tuple[str, str | None]], str | None]:
    """Lines with their comments by one walk over both texts, or why they can't be fitted."""
    bare = lambda x: "".join(x.split())
    flat = lambda xs: [re.sub(r"\s+", " ", x) for x in xs]
    ahead, told, lines, added = deque(flat(corrected)), iter(comments), [], set()
    for n, line in enumerate(flat(code)):
        if not ahead:
            return [], "the corrected text has fewer lines"
        have = ahead.popleft()
        if bare(line) != bare(have):
            if bare(line) in bare(have):
                # several code lines in one: the rest is a line of its own, without a comment
                ahead.appendleft(have.replace(line.strip(), "", 1))
                added.add(n + 1)
            else:
                line = have
        lines.append(line)
        if most is not None and len(added) > most:
            return [], f"more than {most} repairs"
    if len(comments) + len(added) != len(lines):
        return [], "the comments don't fit the lines"
    return [(line, None if n in added else next(told)) for n, line in enumerate(lines)], None


def repair_alignment(code: DataFrame, comments: DataFrame, corrected: DataFrame, compat: bool = False, most: int | None = None) -> DataFrame:
    """Fits comments (one for each corrected line) to code lines, file by file: file, line_number, content, comment, reason.

    A file with as many comments as code lines stays as it is, and never leaves the JVM. In others runs of white space become one blank, and lines are aligned by their least
    edits (``alignment.fitted``), so a line that was lost, came in, was split or joined costs no other line its comment. A file whose comments aren't as many as its corrected lines is one
    row with the reason and nothing else, for it must be documented again. With ``compat`` the texts are walked through once, and a file also goes where lines were lost, or more than ``most`` split.
    The three tables are (file, line_number, content); a file is handled in one task.
    """
    ship(code.sparkSession)
    texts = lambda t, name: t.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda x: x["content"]).alias(name))
    files = texts(code, "c").join(texts(comments, "n"), "file", "left").join(texts(corrected, "x"), "file", "left")
    files = files.select("file", "c", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in ("n", "x")])
    files = materialise(files, "alignment")
    same = F.size("c") == F.size("n")
    kept = files.filter(same).select("file", F.posexplode(F.arrays_zip("c", "n")).alias("line_number", "l")).select("file", "line_number", F.col("l.c").alias("content"), F.col("l.n").alias("comment"), F.lit(None).cast("string").alias("reason"))
    kind = dict(code.dtypes)["file"]
    schema = f"file {kind}, lines array<struct<content: string, comment: string>>, reason string"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists, reasons = [], []
            for c, n, x in zip(*(b.column(k).to_pylist() for k in ("c", "n", "x")), strict=True):
                c, x = [t or "" for t in c], [t or "" for t in x]
                if compat:
                    found, why = _walked(c, n, x, most)
                elif len(n) == len(x):
                    found, why = alignment.fitted(c, x, n), None
                else:
                    found, why = [], "the comments don't fit the corrected lines"
                lists.append([{"content": t, "comment": s} for t, s in found] if why is None else None)
                reasons.append(why)
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(lists, pa.list_(pa.struct([("content", pa.string()), ("comment", pa.string())]))), pa.array(reasons, pa.string())], ["file", "lines", "reason"])

    fitted = files.filter(~same).mapInArrow(run, schema).select("file", F.posexplode_outer("lines").alias("line_number", "l"), "reason")
    return kept.unionByName(fitted.select("file", "line_number", F.col("l.content").alias("content"), F.col("l.comment").alias("comment"), "reason"))


def comment_lines_for(generated: DataFrame, lines: DataFrame, compat: bool = False) -> DataFrame:
    """The first line that holds each generated snippet: (file, comment_id, snippet) to (file, comment_id, line_number). Its identifiers must stand whole; with ``compat`` any substring counts."""
    if compat:
        joined = generated.join(lines, "file").filter(F.contains("content", "snippet"))
        return joined.groupBy("file", "comment_id").agg(F.min("line_number").alias("line_number"))
    return first_lines(generated, lines, "comment_id")


def numbered_prompt(text: Column | str) -> Column:
    """A text with the number of each line before it, from 0."""
    return F.array_join(F.transform(X.lines(text), lambda x, i: F.concat(i.cast("string"), F.lit(": "), x)), "\n")

"""The three whole flows: raw corpus to deduplicated corpus, documented corpus to training pairs, samples to pass@k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import plugins
from textloom.functions import text as X
from textloom.operators import dedup, grading, library, lines, pairs, splits, units
from textloom.storage import materialise


@dataclass
class Corpus:
    """kept: the corpus; metadata and names: of all valid modules, before copies go; rejected: those with a syntax error."""

    kept: DataFrame
    metadata: DataFrame
    names: DataFrame
    rejected: DataFrame


def preprocess(raw: DataFrame, checker: plugins.SyntaxChecker | None = None, percent: int = 80, policy: str = "first_seen", compat: bool = False, max_tokens: int = 1024 * 16) -> Corpus:
    """Splits files into modules, cleans and filters them, cheap filters first, and removes near copies. raw: (task_id, text)."""
    rows = units.separated(raw)
    rows = rows.withColumn("text", units.remove_comment_lines("text", compat))
    rows = rows.withColumn("text", units.keep_module_lines("text"))
    rows = rows.filter(units.is_valid_module("text", compat)).filter(X.fits("text", max_tokens))
    checked = materialise(plugins.checked(rows, checker or plugins.StructureChecker()), "checked")
    valid = checked.filter("ok")
    meta = valid.select(F.col("task_id").cast("string").alias("task_id"), F.col("module_name").alias("code_name"), "module_inst_list", F.lit(None).cast("string").alias("error"), F.col("text").alias("code_str"))
    keep = dedup.first_seen if policy == "first_seen" else dedup.extremes
    kept = keep(valid.select("task_id", "module_name", "text", "module_inst_list"), percent, id_col="task_id")
    return Corpus(kept, meta, library.ids_by_name(meta), checked.filter("not ok"))


def training_pairs(modules: DataFrame, system: str, question: str) -> DataFrame:
    """All pair formats of documented modules (lines, module_header, block_summary, summaries), with their format."""
    tables = {
        "detailed": pairs.question_pairs(modules, "global_summary_detailed", system, question),
        "simple": pairs.question_pairs(modules, "global_summary_high_level", system, question),
        "summary_to_blocks": pairs.summary_to_blocks(modules, "global_summary_high_level", system, skip_single=True),
        "blocks_to_code": pairs.blocks_to_code(modules, system),
        "blocks_global_to_code": pairs.blocks_to_code(modules, system, with_global="global_summary_high_level"),
    }
    return splits.union_all(*[t.withColumn("format", F.lit(k)) for k, t in tables.items()])


def documented(files: DataFrame, completer: plugins.Completer, size: int = 10) -> DataFrame:
    """Files (file, text) to their chunks with comments and a summary of each chunk."""
    table = lines.line_table(files)
    code, comments = lines.align_comments(table.filter(F.trim("content") != ""), F.ltrim("content").startswith("//"))
    chunks = lines.chunks(code, comments, size)
    return chunks.withColumn("summary", X.block_text(plugins.completed(completer, F.col("page_content"))))


def validated(pairs_table: DataFrame, completer: plugins.Completer, checker: plugins.SyntaxChecker, trials: int = 10) -> DataFrame:
    """Pairs whose description leads to valid code again."""
    return plugins.first_valid(pairs_table, completer, checker, "description", trials).filter(F.col("completion").isNotNull()).select(*pairs_table.columns)


def generated(descriptions: DataFrame, headers: DataFrame, completer: plugins.Completer, k: int, system: str, kind: str = "llm1") -> DataFrame:
    """k samples of each task from its detailed description, or else the simple one, and its header: task_id, sample, completion.

    descriptions: (task_id, detail_description, simple_description); headers: (task_id, module_header). Each sample's prompt tells its number, so that a model may answer it anew.
    """
    rows = pairs.with_fallback(descriptions, k).join(headers.select("task_id", "module_header"), "task_id")
    prompt = pairs.evaluation_prompt(kind, system, F.col("description"), F.col("module_header"))
    numbered = F.concat(prompt, F.lit("\n# sample "), F.col("sample").cast("string"))
    return rows.select("task_id", "sample", plugins.completed(completer, numbered).alias("completion"))


def grade(samples: DataFrame, problems: DataFrame, simulator: plugins.Simulator, order: str, ks: tuple[int, ...] = (1, 10, 100), tests: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of all samples, and pass@k. Stops if a problem has no sample or a sample no problem."""
    if grading.unattempted(problems, samples).limit(1).count():
        raise ValueError("some problems were not attempted")
    joined = grading.completion_ids(grading.attach_problems(samples, problems), order)
    if tests is not None:
        joined = joined.withColumn("test", X.override_repeats("test", tests))
    ran = plugins.simulated(joined, simulator)
    results = ran.withColumn("result", grading.classify(F.col("stdout"), F.col("stderr"), F.col("timed_out"))).withColumn("passed", F.col("result") == "passed")
    results = materialise(results.select("task_id", "completion_id", "completion", "result", "passed"), "results")
    return results, grading.pass_at_k(results, ks)

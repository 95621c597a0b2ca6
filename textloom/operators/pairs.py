"""Prompts and training pairs as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.text import B_INST, B_SYS, E_INST, E_SYS

PROMPT_TYPES = ("baseline", "llm1", "llm2_block_to_code", "llm2_block_global_to_code")


def chat(user: Column, system: Column | str | None = None, memory: Column | None = None) -> Column:
    """A conversation turn in the chat template, with a system message and what was said before where given."""
    parts = [F.lit(B_INST + " ")]
    if system is not None:
        parts += [F.lit(B_SYS), F.lit(system) if isinstance(system, str) else system, F.lit(E_SYS)]
    if memory is not None:
        parts += [memory, F.lit("\n\n")]
    return F.concat(*parts, user, F.lit(" " + E_INST))


def question_pairs(modules: DataFrame, summary: str, system: str, question: str) -> DataFrame:
    """description = the question on a module's summary and header, code = its lines without the header: modules (lines, module_header, ...)."""
    said = F.concat(F.lit(question + "\n"), F.col(summary), F.lit("\n\n"), F.col("module_header"))
    return modules.select(X.without_header(F.col("lines"), F.col("module_header")).alias("code"), chat(said, system).alias("description"))


def block_list(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("\nblock_"), i.cast("string"), F.lit(": "), b, F.lit("\n"))), "")


def summary_to_blocks(modules: DataFrame, summary: str, system: str, skip_single: bool = False) -> DataFrame:
    rows = modules.filter(F.size("block_summary") > 1) if skip_single else modules
    said = F.concat(F.col(summary), F.lit("\n\n"), F.col("module_header"))
    return rows.select(block_list(X.block_summary(F.col("block_summary"))).alias("code"), chat(said, system).alias("description"))


def blocks_to_code(modules: DataFrame, system: str, with_global: str | None = None) -> DataFrame:
    """Blocks, and with ``with_global`` also that summary where there are several blocks, to code."""
    blocks = block_list(X.block_summary(F.col("block_summary")))
    said = blocks
    if with_global:
        said = F.when(F.size("block_summary") > 1, F.concat(F.col(with_global), F.lit("\n"), blocks)).otherwise(blocks)
    said = F.concat(said, F.lit("\n\n"), F.col("module_header"))
    return modules.select(X.without_header(F.col("lines"), F.col("module_header")).alias("code"), chat(said, system).alias("description"))


def benchmark_blocks(modules: DataFrame, global_summary: str) -> DataFrame:
    blocks = block_list(X.block_summary(F.col("block_summary")))
    both = F.when(F.size("block_summary") > 1, F.concat(F.col(global_summary), F.lit("\n"), blocks)).otherwise(blocks)
    return modules.select("task_id", blocks.alias("block_to_code_description"), both.alias("block_global_to_code_description"))


def benchmark_descriptions(modules: DataFrame, column: str, name: str) -> DataFrame:
    return modules.select("task_id", F.col(column).alias(name))


def evaluation_prompt(kind: str, system: Column | str, description: Column, header: Column) -> Column:
    if kind not in PROMPT_TYPES:
        raise ValueError(f"unknown prompt type {kind}")
    said = F.concat(description, F.lit("\n\n"), header)
    return chat(said, system) if kind != "baseline" else F.concat(said, F.lit("\n"))


def evaluation_prompts(kind_col: Column, system: str, description: Column, header: Column) -> Column:
    """The same with a kind on each row."""
    out = None
    for kind in PROMPT_TYPES:
        p = evaluation_prompt(kind, system, description, header)
        out = F.when(kind_col == kind, p) if out is None else out.when(kind_col == kind, p)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown prompt type "), F.coalesce(kind_col, F.lit("null")))))


def few_shot(descriptions: DataFrame, examples: DataFrame, text: str) -> DataFrame:
    """One text of the examples (task_id, at, code) with their descriptions, in order."""
    joined = examples.join(descriptions.select("task_id", F.col(text).alias("said")), "task_id")
    item = F.struct("at", F.concat("said", F.lit("\n"), "code").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x, i: F.concat(F.lit("Example: "), i.cast("string"), F.lit(" "), x["v"], F.lit("\n")))
    return joined.agg(F.array_join(listed, "").alias("examples"))


def budgeted(user: Column, examples: Column, user_tokens: int = 15000, all_tokens: int = 16000, fence: str = "\n```") -> Column:
    """User text within its budget, then the examples within what is left of the whole."""
    u = X.cut_to_tokens(user, user_tokens, fence)
    room = F.greatest(F.lit(all_tokens) - X.token_estimate(u), F.lit(0))
    return F.concat(X.cut_to_tokens(examples, room, fence), u)


def line_prompt(batch: DataFrame, helpers: Column) -> Column:
    return F.concat(F.lit("Context above:\n"), F.col("above"), F.lit("\nHelpers:\n"), helpers, F.lit("\nLines:\n"), F.col("text"), F.lit("\nContext below:\n"), F.col("below"))


def steps_prompts(modules: DataFrame, chunks: DataFrame, summary: str) -> DataFrame:
    """One row per chunk with its module's summary and header."""
    joined = chunks.join(modules.select("file", F.col(summary).alias("summary"), "module_header"), "file")
    return joined.select("file", "chunk_idx", F.concat_ws("\n", "summary", "module_header", "page_content").alias("prompt"))


def with_header(descriptions: DataFrame, headers: DataFrame, text: str = "description") -> DataFrame:
    return descriptions.join(headers.select("task_id", "module_header"), "task_id").withColumn("prompt", F.concat(F.col(text), F.lit("\n\n"), F.col("module_header")))


#: What asks a model to repair a reply.
REPAIR = "Fix the output format:\n{instructions}\n"


def repair_request(instructions: str, reply: str) -> str:
    return REPAIR.format(instructions=instructions) + reply


def repair_prompt(instructions: str, reply: Column) -> Column:
    return F.concat(F.lit(REPAIR.format(instructions=instructions)), reply)


def reverse_prompts(summaries: DataFrame, comments: DataFrame) -> DataFrame:
    from textloom.operators.lines import ordered_concat

    notes = comments.groupBy("file").agg(ordered_concat("line_number", "content", "\n").alias("notes"))
    return summaries.join(notes, "file").select("file", F.concat("summary", F.lit("\n"), "notes").alias("prompt"))


def with_fallback(rows: DataFrame, k: int) -> DataFrame:
    """The detailed description or else the simple one, k times."""
    said = rows.withColumn("description", F.coalesce("detail_description", "simple_description"))
    return said.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("sample"))


def fine_tuning_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("description").alias("input"), F.col("code").alias("output"))


def with_length(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("length", F.length("input") + F.length("output"))


#: The two templates of instruction data, with and without an input.
ALPACA = (
    "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response: ",
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response: ",
)


def chip2_columns(text: str) -> list[Column]:
    parts = F.split(text, "\n<bot>: ")
    return [F.replace(F.element_at(parts, 1), F.lit("<human>: "), F.lit("")).alias("input"), F.get(parts, 1).alias("output")]


def formatted(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a public instruction dataset as (input, output)."""
    if kind == "alpaca":
        filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{instruction}"), F.col("instruction")), F.lit("{input}"), F.coalesce("input", F.lit("")))
        return rows.select(F.when(F.coalesce("input", F.lit("")) != "", filled(ALPACA[0])).otherwise(filled(ALPACA[1])).alias("input"), "output")
    if kind == "chip2":
        return rows.select(*chip2_columns("text"))
    if kind == "self-instruct":
        return rows.select(F.col("prompt").alias("input"), F.col("completion").alias("output"))
    if kind == "hh-rlhf":
        return rows.select(F.lit("").alias("input"), F.col("chosen").alias("output"))
    if kind == "oasst1":
        return rows.select(F.lit("").alias("input"), F.col("text").alias("output"))
    if kind == "pairs":
        return fine_tuning_columns(rows)
    if kind == "input-output":
        return rows.select("input", "output")
    raise ValueError(f"unknown format {kind}")


def flattened_instructions(rows: DataFrame, reformulations: bool = False) -> DataFrame:
    """Instances of each row, and those of its reformulations, one row each."""
    one = rows.select(F.explode("instances").alias("x")).select(F.col("x.instruction_with_input").alias("input"), F.col("x.output").alias("output"))
    if not reformulations:
        return one
    more = rows.filter(F.col("reformulations").isNotNull()).select(F.explode("reformulations").alias("x"))
    return one.unionByName(more.select(F.col("x.instruction_with_input").alias("input"), F.col("x.output").alias("output")))


def causal_tokens(source: Column, target: Column, bos: int, eos: int, source_max: int = 2048, target_max: int = 1024, train_on_source: bool = False) -> tuple[Column, Column]:
    """Input ids and labels of a pair of id arrays; labels are -100 over the source unless it is trained on too."""
    s = F.slice(F.concat(F.array(F.lit(bos)), source), 1, source_max)
    t = F.slice(F.concat(target, F.array(F.lit(eos))), 1, target_max)
    ids = F.concat(s, t)
    return ids, ids if train_on_source else F.concat(F.array_repeat(F.lit(-100), F.size(s)), t)


def padded(ids: Column, size: Column | int, fill: int) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(n - F.size(ids), F.lit(0)).cast("int")))


def example_map(problems: DataFrame, ids: list[str]) -> DataFrame:
    """One map from chosen tasks to their code."""
    chosen = problems.filter(F.col("task_id").isin(ids))
    return chosen.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_id", F.concat("prompt", "canonical_solution").alias("code"))))).alias("examples"))


def system_message(text: Column, *messages: str) -> Column:
    return F.concat_ws("\n", text, *map(F.lit, messages))


def format_instructions(schema) -> str:
    """What tells a model the JSON it should return."""
    return f"The output should be JSON of this schema: {schema.json()}"


def token_totals(modules: DataFrame) -> DataFrame:
    """Estimated tokens of code, summary, blocks, comments and code lines, and the sizes of the four training formats."""
    each = lambda c: F.aggregate(F.transform(F.col(c), X.token_estimate), F.lit(0).cast("bigint"), lambda a, x: a + x)
    t = modules.select("task_id", X.token_estimate("code").alias("code"), X.token_estimate("summary").alias("summary"), each("block_summary").alias("blocks"), each("comments").alias("comments"), each("lines").alias("lines"))
    return t.withColumns({"llm1": F.col("summary") + F.col("code"), "llm2": F.col("summary") + F.col("blocks"), "llm3": F.col("blocks") + F.col("code"), "llm4": F.col("comments") + F.col("lines")})

"""Scalar text functions as column expressions. All stay inside generated code; the line folds that need state are in code_text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import code_text

#: Fixed value: what ends a code token.
NOT_TOKEN = "[^A-Za-z_0-9]"
#: Fixed value: the word for a line without a comment in line tables.
NO_COMMENT = "no_comment"
#: Conversation templates of the fine-tuning data.
B_INST, E_INST, B_SYS, E_SYS = "[INST]", "[/INST]", "<<SYS>>\n", "\n<</SYS>>\n\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strips all Unicode white space, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def lines(c: Column | str) -> Column:
    """Lines of a text, cut at each newline."""
    return F.split(col(c), "\n")


def py_splitlines(c: Column | str) -> Column:
    """Lines without the empty one that a final newline leaves."""
    parts = F.split(col(c), "\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def join_lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def is_blank(c: Column | str) -> Column:
    """Null, empty or blank, or one of the words that stand for a missing value."""
    return col(c).isNull() | py_strip(c).isin("", "None", NO_COMMENT)


def expand_tabs(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\t"), F.lit("    "))


def cut_line_comments(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "//[^\n]*", "")


def cut_comments(c: Column | str) -> Column:
    """Line comments first, then block comments; strings in the code are not looked at."""
    return F.regexp_replace(cut_line_comments(c), r"(?s)/\*.*?\*/", "")


def drop_blank_lines(c: Column | str) -> Column:
    return join_lines(F.filter(lines(c), lambda x: x.rlike(r"(?U)\S")))


def separate_module_args(c: Column | str) -> Column:
    """On lines that begin a module, a new line after the argument list, or else after each semicolon."""

    def one(x: Column) -> Column:
        return F.when(~py_strip(x).startswith("module"), x).when(x.rlike(r"\)\s*;"), F.regexp_replace(x, r"\)\s*;", ");\n")).otherwise(F.replace(x, F.lit(";"), F.lit(";\n")))

    return join_lines(F.transform(lines(c), one))


def one_line(c: Column | str) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(col(c), r"(?U)\s+", " ")


def squeeze(c: Column | str) -> Column:
    """Without newlines, blanks and tabs, to compare code by."""
    return F.translate(col(c), "\n \t", "")


def same_code(a: Column | str, b: Column | str) -> Column:
    return squeeze(a) == squeeze(b)


def block_text(c: Column | str) -> Column:
    """What follows the first colon that ends a line, or all."""
    return F.element_at(F.split(col(c), ":\n", 2), -1)


def body_after_header(c: Column | str) -> Column:
    """What follows the first semicolon, or all."""
    return F.element_at(F.split(col(c), ";", 2), -1)


def without_header(text_lines: Column, header: Column) -> Column:
    """Lines joined by blanks, less the header, which must occur."""
    joined = F.array_join(text_lines, " ")
    return F.when(F.contains(joined, header), F.replace(joined, header, F.lit(""))).otherwise(F.raise_error(F.lit("the header is not in the code")))


def block_summary(blocks: Column) -> Column:
    """The cleaned text of a module's only block: JSON with usage and summary, or what follows "summary:" and "provided:"; several blocks stay as they are."""
    first = F.element_at(blocks, 1)
    parsed = F.from_json(first, "usage STRING, summary STRING")

    def after(c: Column, mark: str) -> Column:
        parts = F.split(c, mark)
        return F.when(F.size(parts) > 2, F.raise_error(F.lit(f"more than one {mark}"))).when(F.size(parts) == 2, py_strip(F.element_at(parts, 2))).otherwise(c)

    single = F.coalesce(F.concat(parsed["usage"], F.lit("; "), parsed["summary"]), after(after(first, "summary:"), "provided:"))
    return F.when(F.size(blocks) == 1, F.array(single)).otherwise(blocks)


def list_or_empty(c: Column | str) -> Column:
    """An array of strings; an empty one for null."""
    return F.coalesce(col(c), F.array().cast("array<string>"))


def json_in(c: Column | str, schema: str) -> Column:
    """The struct in the widest braces of a reply; null if it can't be parsed."""
    return F.from_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), schema, {"allowUnquotedControlChars": "true"})


def repair_literals(c: Column | str) -> Column:
    out = col(c)
    for old, new in (("null", '""'), ("False", "false"), ("True", "true")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def override_repeats(c: Column | str, n: int) -> Column:
    return F.regexp_replace(col(c), r"repeat\([0-9]*\)", f"repeat({n})")


def rename_module(c: Column | str, old: str, new: Column) -> Column:
    return F.replace(col(c), F.lit(old), new)


def code_tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), NOT_TOKEN), lambda t: F.length(t) > 0)


def token_set(c: Column | str) -> Column:
    return F.array_distinct(code_tokens(c))


def token_estimate(c: Column | str) -> Column:
    """The offline stand-in for a tokenizer's count: a token for each four characters begun."""
    return F.ceil(F.length(col(c)) / 4).cast("bigint")


def cut_to_tokens(c: Column | str, tokens: int | Column, tail: str = "") -> Column:
    """At most so many estimated tokens; what is cut gets ``tail``."""
    most = (F.lit(tokens) if isinstance(tokens, int) else tokens) * 4
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(F.substring(col(c), F.lit(1), most.cast("int")), F.lit(tail)))


def stem(c: Column | str) -> Column:
    return F.substring_index(col(c), ".", 1)


def hour_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd-HH")


def minute_stamp(c: Column | str) -> Column:
    return F.date_format(col(c), "HH-mm")


def module_header(c: Column | str) -> Column:
    """The text up to its first semicolon, with it; null without one."""
    return F.when(F.contains(col(c), F.lit(";")), F.concat(F.substring_index(col(c), ";", 1), F.lit(";")))


def header_on_one_line(c: Column | str) -> Column:
    """The header's runs of white space collapsed, the rest as it is."""
    return F.when(F.contains(col(c), F.lit(";")), F.concat(one_line(module_header(c)), F.substring(col(c), F.instr(col(c), ";") + 1, F.length(col(c))))).otherwise(col(c))


def _begins(c: Column | str, pattern: str) -> Column:
    s = py_strip(c)
    return ~s.startswith("//") & ~s.startswith("/*") & ~s.startswith("*") & s.rlike(pattern)


def is_module_line(c: Column | str) -> Column:
    return _begins(c, code_text.MODULE_LINE)


def is_function_line(c: Column | str) -> Column:
    return _begins(c, code_text.FUNCTION_LINE)


def is_array_line(c: Column | str) -> Column:
    return _begins(c, code_text.ARRAY_LINE)


def fits(c: Column | str, tokens: int = 1024 * 16) -> Column:
    """Within the corpus's limit of tokens."""
    return token_estimate(c) <= tokens


def few_lines(c: Column | str, most: int = 200) -> Column:
    return F.size(lines(c)) <= most


def enough_tokens(c: Column | str, least: int = 10) -> Column:
    """Occurrences, not distinct tokens; shorter texts are never taken as duplicates."""
    return F.size(code_tokens(c)) >= least


COMMENT_REPLY = "comment_exist ARRAY<BOOLEAN>, comment ARRAY<STRING>, line_number ARRAY<INT>"


def valid_comment_reply(reply: Column) -> Column:
    """Lists of one length, line numbers unique and without gaps."""
    n = reply["line_number"]
    dense = F.when(F.size(n) == 0, F.lit(True)).otherwise(F.array_sort(n) == F.sequence(F.array_min(n), F.array_max(n)))
    return F.coalesce((F.size(n) == F.size(reply["comment"])) & (F.size(n) == F.size(reply["comment_exist"])) & dense, F.lit(False))


SQL_FUNCTIONS = {
    "code_tokens": ("text STRING", "ARRAY<STRING>", "filter(split(text, '[^A-Za-z_0-9]'), t -> length(t) > 0)"),
    "token_estimate": ("text STRING", "BIGINT", "cast(ceil(length(text) / 4) AS BIGINT)"),
    "squeeze": ("text STRING", "STRING", "translate(text, '\\n \\t', '')"),
    "stem": ("name STRING", "STRING", "substring_index(name, '.', 1)"),
    "body_after_header": ("text STRING", "STRING", "element_at(split(text, ';', 2), -1)"),
}


def register(spark) -> None:
    """The same functions for SQL texts. Catalyst inlines them."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")

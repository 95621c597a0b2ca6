"""Grading generated samples: outcomes, pass@k, failure profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the simulator's line that tells mismatches.
MISMATCHES = r"Mismatches: ([0-9]*) in ([0-9]*) samples"


def classify(stdout: Column, stderr: Column, timed_out: Column) -> Column:
    """The verdict on a simulator run, in the order in which the causes count."""
    wrong, total = F.regexp_extract(stdout, MISMATCHES, 1), F.regexp_extract(stdout, MISMATCHES, 2)
    return (
        F.when(timed_out, F.lit("timed out"))
        .when(F.contains(stderr, F.lit("syntax error")), F.lit("failed: syntax error."))
        .when(F.length(stderr) > 0, F.lit("failed: compile error."))
        .when(~stdout.rlike(MISMATCHES), F.lit("failed: info string not matched."))
        .when(wrong.cast("int") == 0, F.lit("passed"))
        .otherwise(F.concat(F.lit("failed: "), wrong, F.lit(" out of "), total, F.lit(" samples.")))
    )


def last_problems(problems: DataFrame, order: str) -> DataFrame:
    """One problem per task; the last of a task counts."""
    from textloom.operators.library import last_by_key

    return last_by_key(problems, ["task_id"], order)


def attach_problems(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Each sample with its problem; a sample of an unknown task stops the query."""
    p = problems.withColumn("__known", F.lit(True))
    joined = samples.join(p, "task_id", "left")
    return joined.withColumn("task_id", F.when(F.col("__known"), F.col("task_id")).otherwise(F.raise_error(F.concat(F.lit("no problem for task "), F.col("task_id"))))).drop("__known")


def unattempted(problems: DataFrame, samples: DataFrame) -> DataFrame:
    return problems.join(samples.select("task_id").distinct(), "task_id", "left_anti")


def completion_ids(samples: DataFrame, order: str, key: str = "task_id") -> DataFrame:
    """Numbers the samples of each task from 0."""
    from textloom.operators.units import numbered_within

    return numbered_within(samples, key, order, name="completion_id").withColumn("completion_id", F.col("completion_id").cast("int"))


def attach_results(samples: DataFrame, results: DataFrame) -> DataFrame:
    """The n-th result of a task belongs to its n-th sample."""
    return samples.join(results.select("task_id", "completion_id", "result", "passed"), ["task_id", "completion_id"])


def totals(results: DataFrame, key: str = "task_id") -> DataFrame:
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))


def pass_rate(n: Column, c: Column, k: int) -> Column:
    """The chance that one of k samples drawn from n passes, c of which do."""
    left = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - left)


def pass_at_k(results: DataFrame, ks: tuple[int, ...] = (1, 10, 100), key: str = "task_id") -> DataFrame:
    """k and pass_at_k, the mean over tasks; a k that some task has too few samples for is left out."""
    t = totals(results, key)
    cols = [F.avg(pass_rate(F.col("n"), F.col("c"), k)).alias(f"p{k}") for k in ks]
    row = t.agg(F.min("n").alias("least"), *cols)
    stacked = ", ".join(f"{k}, p{k}" for k in ks)
    return row.selectExpr("least", f"stack({len(ks)}, {stacked}) AS (k, pass_at_k)").filter("least >= k").select("k", "pass_at_k")


def any_pass(results: DataFrame) -> DataFrame:
    """Whether a task passes, and its first passing completion or ''."""
    g = results.groupBy("task_id").agg(F.bool_or("passed").alias("passed"), F.min_by("completion", F.when(F.col("passed"), F.col("completion_id"))).alias("first"))
    return g.select("task_id", "passed", F.when(F.col("passed"), F.col("first")).otherwise(F.lit("")).alias("completion"))


def sorted_results(results: DataFrame) -> DataFrame:
    return results.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("completion_id", "passed", "result"))).alias("results"))


def never_passed(results: DataFrame, key: str = "task_id") -> DataFrame:
    return results.groupBy(key).agg(F.bool_or("passed").alias("ok")).filter(~F.coalesce("ok", F.lit(False))).select(key)


def fan_out(rows: DataFrame, k: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("sample"))


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (from 0), lo, hi, n over equal widths from least to greatest; the last bin holds the greatest value."""
    ends = rows.agg(F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("least")) / width), F.lit(bins - 1))).cast("int")
    counted = rows.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).withColumn("bin", at).groupBy("bin").agg(F.first("least").alias("lo0"), F.first("most").alias("hi0"), F.count(F.lit(1)).alias("n"))
    w = (F.col("hi0") - F.col("lo0")) / bins
    return counted.select("bin", (F.col("lo0") + F.col("bin") * w).alias("lo"), (F.col("lo0") + (F.col("bin") + 1) * w).alias("hi"), "n")


def failure_rates(rows: DataFrame, value: str, failed: Column, edges: int = 10) -> DataFrame:
    """bin, total, failures, rate over bins that both share: ``edges`` edges from least to greatest value of all rows."""
    bins = edges - 1
    ends = rows.agg(F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.least(F.floor((F.col(value) - F.col("least")) / width), F.lit(bins - 1)).cast("int")
    g = rows.join(F.broadcast(ends)).withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures"))
    return g.withColumn("rate", F.col("failures") / (F.col("total") + F.lit(1e-6)))


def profile(results: DataFrame, problems: DataFrame) -> DataFrame:
    """Results with header, solution and the sizes of their problems."""
    from textloom.functions import text as X

    p = problems.select("task_id", F.col("prompt").alias("header"), "canonical_solution", F.size(X.lines("canonical_solution")).alias("code_lines"), X.token_estimate("canonical_solution").alias("code_tokens"))
    return results.join(p, "task_id")


def accuracy_by_subject(rows: DataFrame, subject: str, reference: str, predicted: str) -> DataFrame:
    """subject, accuracy, and the mean over subjects on every row."""
    g = rows.groupBy(subject).agg(F.avg((F.col(reference) == F.col(predicted)).cast("double")).alias("accuracy"))
    return g.crossJoin(F.broadcast(g.agg(F.avg("accuracy").alias("macro"))))


def latest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    """The greatest number of the folders checkpoint-<n>; null if a marker says the run is complete."""
    n = F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    return names.agg(F.when(F.coalesce(F.bool_or(F.col(name) == "completed"), F.lit(False)), F.lit(None)).otherwise(F.max(F.when(n != "", n.cast("int")))).alias("step"))

"""The library where workers don't have the repository on their path and no setting names a shared folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, ROOT)
from pyspark.sql import functions as F
from textloom import storage
from textloom.functions import plugins
from textloom.operators import dedup, lines, retrieval, units
from textloom.plans import flows
from textloom.session import local_session
from textloom.sources import readers, writers

spark = local_session(2, 2, "1g")
assert not spark.conf.get("spark.checkpoint.dir", None)
docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 3, 30))) for i in range(6)], "doc_id bigint, text string")
dedup.first_seen(docs).write.parquet("kept")
assert spark.read.parquet("kept").count() == 1
assert storage.shared_dir(spark) == storage.shared_dir(spark)
raw = spark.createDataFrame([("0", "module a(input x, output y);\\n  assign y = x;\\nendmodule\\nmodule b(input x, output y);\\n  assign y = ~x;\\n a u(x, y);\\nendmodule\\n")], "task_id string, text string")
corpus = flows.preprocess(raw)
assert {r.module_name for r in corpus.kept.collect()} == {"a"} and corpus.metadata.count() == 2
assert units.module_rows(raw).count() == 2 and raw.select(units.tidy("text")).count() == 1
table = lines.line_table(raw, "task_id")
short = table.filter("line_number < 4").selectExpr("file", "line_number", "cast('note' as string) AS content")
assert lines.repair_alignment(table, short, short).count() >= 1
m = spark.createDataFrame([("module a; endmodule", "a", "p")], "text string, module_name string, prompt string")
assert plugins.checked(m, plugins.StructureChecker()).first().ok
assert m.select(plugins.completed(plugins.EchoCompleter(), F.col("prompt")).alias("x")).first().x
assert plugins.first_valid(m, plugins.EchoCompleter(), plugins.StructureChecker(), trials=2).first().attempts == 2
assert m.select(plugins.token_count(plugins.CharTokenizer(), F.col("text")).alias("n"), plugins.embedded(plugins.HashEmbedder(4), F.col("text")).alias("v")).first().n == 5
assert lines.bordered_chunks(raw, "task_id", "text", 40, 10).count() > 1
samples = m.selectExpr("prompt", "'c' AS completion", "'t' AS test")
assert plugins.simulated(samples, plugins.RecordedSimulator({"c": ("out", "", False)})).first().stdout == "out"
import os
where = "file://" + os.getcwd() + "/files"
assert writers.one_file_per_row(raw, where).count() == 1 and readers.flat_directory(spark, where).count() == 1
v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id bigint, embedding array<double>")
assert retrieval.most_similar(v.withColumnRenamed("vec_id", "query_id"), v, 1).count() == 4
"""


def test_without_the_path_and_the_setting(tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "work").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    subprocess.run([sys.executable, "-c", CODE.replace("ROOT", repr(str(ROOT)), 1)], cwd=tmp_path / "work", check=True, timeout=600, env=env)

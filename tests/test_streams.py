"""Streams that were stopped and started again against one run over the whole table."""

from pyspark.sql import functions as F

from textloom.operators import lines
from textloom.streaming import histories

BLOCKS = [("f", 0, "c0"), ("f", 1, "c1"), ("f", 2, None), ("f", 3, "c3"), ("g", 0, "d0"), ("g", 1, "d1"), ("h", 0, "e0")]
SCHEMA = "file string, block long, code string"


def summarise(history, code):
    return f"{len(history)}-{code}"


def stream(spark, tmp_path, start, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_summaries_go_on(spark, tmp_path):
    parts = [BLOCKS[:2] + BLOCKS[4:5], BLOCKS[2:3] + [(None, 4, "no"), ("f", None, "no")], [], [BLOCKS[1], BLOCKS[3], BLOCKS[6], BLOCKS[5]]]
    got = stream(spark, tmp_path, lambda *a: histories.document_blocks(*a, summarise), parts, SCHEMA)
    whole = spark.createDataFrame([(f, b, c or "") for f, b, c in BLOCKS], "file string, block int, code string")
    want = lines.running_history(whole, summarise)
    key = lambda df: sorted((r.file, r.block, r.code, r.summary, r.history) for r in df.collect())
    assert key(got) == key(want)


def test_state_goes_by_a_timer(spark, tmp_path):
    start = lambda *a: histories.document_blocks(*a, summarise, keep_hours=0)
    got = stream(spark, tmp_path, start, [[("f", 0, "c0")], [("g", 0, "d0")], [("f", 1, "c1")]], SCHEMA)
    assert {(r.file, r.block): r.history for r in got.collect()} == {("f", 0): "", ("g", 0): "", ("f", 1): ""}


def test_memory_goes_on(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 else "assistant", f"text {t}" if t != 3 else None) for t in range(9)] + [(2, 0, "user", "a")]
    schema = "conv_id long, turn long, role string, text string"
    got = stream(spark, tmp_path, histories.remember, [turns[:3], turns[3:8] + turns[2:3], turns[8:]], schema)
    whole = spark.createDataFrame([(c, t, r, x or "") for c, t, r, x in turns], schema)
    want = lines.memory(whole)
    key = lambda df: sorted((r.conv_id, r.turn, r.role, r.text, r.memory) for r in df.collect())
    assert key(got) == key(want) and got.filter(F.size(F.split("memory", "\n")) > 4).count() == 0

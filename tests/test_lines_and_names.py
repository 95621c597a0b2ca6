"""Alignment by least edits, whole identifiers, the stored vector index, computed shuffles."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import alignment
from textloom.operators import lines, names, retrieval, splits, units
from textloom.operators.vector_index import VectorIndex

WORDS = st.lists(st.sampled_from("abcd"), max_size=9)


def shortest(a, b):
    """The length of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_least_edits(a, b):
    pairs = alignment._least_edits(a, b, 100)
    assert len(pairs) == shortest(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert alignment._least_edits(["x"] * 5, ["y"] * 5, 3) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=4), max_size=7), st.lists(st.text("ab ", max_size=4), max_size=7))
def test_every_code_line_comes_out_once(code, corrected):
    out = alignment.fitted(code, corrected, [f"n{i}" for i in range(len(corrected))])
    assert len(out) == len(code)
    said = [c for _, text in out if text for c in text.split("\n")]
    assert said == sorted(set(said), key=lambda x: int(x[1:]))  # in order, none twice


def test_edited_texts_keep_their_comments(spark):
    code = [f"x{i} = {i};" for i in range(400)]
    ways = {
        "lost": code[:200] + code[201:],
        "came": [*code[:50], "extra", *code[50:]],
        "split": [*code[:10], "x10 =", "10;", *code[11:]],
        "joined": [*code[:7], " ".join(code[7:10]), *code[10:]],
        "changed": [*code[:300], "x300 = 301;", *code[301:], "more"],
        "all": [*code[:7], " ".join(code[7:10]), "extra", *code[10:100], *code[101:200], "x200 =", "200;", *code[201:]],
    }
    table = lambda rows: spark.createDataFrame([(f, i, x) for f, xs in rows.items() for i, x in enumerate(xs)], "file string, line_number int, content string")
    notes = {f: [f"about {x}" for x in xs] for f, xs in ways.items()}
    got = {}
    for r in lines.repair_alignment(table(dict.fromkeys(ways, code)), table(notes), table(ways)).collect():
        got.setdefault(r.file, {})[r.line_number] = (r.content, r.comment, r.reason)
    told = lambda f: [got[f][i][1] for i in range(400)]
    want = [f"about {x}" for x in code]
    assert told("lost") == [*want[:200], None, *want[201:]] and [got["lost"][i][0] for i in range(400)] == code
    assert told("came") == want
    assert told("split") == [*want[:10], "about x10 =\nabout 10;", *want[11:]]
    assert told("joined") == [*want[:7], "about " + " ".join(code[7:10]), None, None, *want[10:]]
    assert told("changed") == [*want[:300], "about x300 = 301;", *want[301:]] and got["changed"][300][0] == "x300 = 301;"
    assert told("all") == [*want[:7], "about " + " ".join(code[7:10]), None, None, *want[10:100], None, *want[101:200], "about x200 =\nabout 200;", *want[201:]]
    # texts without a line in common are paired, and quickly
    began = time.monotonic()
    out = alignment.fitted([f"a{i}" for i in range(20000)], [f"b{i}" for i in range(19000)], ["n"] * 19000)
    assert len(out) == 20000 and sum(c is not None for _, c in out) == 19000 and time.monotonic() - began < 60
    bad = lines.repair_alignment(table({"f": code}), table({"f": ["n"]}), table({"f": code[:9]})).collect()
    assert [(r.line_number, r.reason) for r in bad] == [(None, "the comments don't fit the corrected lines")]


def test_names_stand_whole(spark):
    functions = spark.createDataFrame([("f", "g", "return bar + $x;"), ("f", "h", "int a = 2a;"), ("f", "i", None), ("e", "g", "a")], "file string, function_name string, text string")
    declared = spark.createDataFrame([("f", s, f"int {s};") for s in ("a", "bar", "ba", "x", "$x", "bar + $x", "+", "std::a")] + [("f", None, "none")], "file string, symbol string, declaration string")
    got = {(r.file, r.function_name): r.used for r in units.used_symbols(functions, declared).collect()}
    assert got == {("f", "g"): ["int $x;", "int bar + $x;", "int bar;"], ("f", "h"): ["int a;"]}
    old = {(r.file, r.function_name): r.used for r in units.used_symbols(functions, declared, compat=True).collect()}
    assert "int a;" in old["f", "g"] and "int ba;" in old["f", "g"]
    batches = spark.createDataFrame([("f", 0, "use top_a and b"), ("f", 0, "use top_a and b"), ("f", 1, "a"), ("f", 2, None)], "file string, at int, text string")
    wanted = spark.createDataFrame([("f", "top_a", 1), ("f", "a", 2), ("g", "b", 3)], "file string, name string, k int")
    hits = retrieval.mentioned(batches, wanted)
    assert hits.columns == ["file", "at", "text", "name", "k"] and sorted((r.at, r.name) for r in hits.collect()) == [(0, "top_a"), (0, "top_a"), (1, "a")]
    assert retrieval.mentioned(batches, wanted, compat=True).count() == 5
    table = lines.line_table(spark.createDataFrame([("f", "int ab;\na + b;\nab += (1);\n);\nx.*\\E[a]")], "file string, text string"))
    asked = spark.createDataFrame([("f", 1, "a"), ("f", 2, "ab +="), ("f", 3, "b +"), ("f", 4, ");"), ("f", 5, "no"), ("f", 6, "*\\E[a]"), ("f", 7, "(1)")], "file string, comment_id int, snippet string")
    assert {r.comment_id: r.line_number for r in lines.comment_lines_for(asked, table).collect()} == {1: 1, 2: 2, 4: 2, 6: 4, 7: 2}
    assert {r.comment_id for r in lines.comment_lines_for(asked, table, compat=True).collect()} == {1, 2, 3, 4, 6, 7}


def test_rows_are_linear_in_a_large_file(spark):
    n = 10_000
    functions = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("g"), "id").alias("function_name"), F.concat(F.lit("int r = v"), "id", F.lit(" + v"), ((F.col("id") + 1) % n).cast("string"), F.lit(";")).alias("text"))
    declared = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("v"), "id").alias("symbol"), F.concat(F.lit("int v"), "id").alias("declaration"))
    assert names.mentions(functions, declared, "file", "function_name", name="symbol").count() == 2 * n
    used = units.used_symbols(functions, declared)
    assert used.count() == n and used.filter(F.size("used") != 2).count() == 0


# ---- vectors


def clustered(rng, groups, each, dim, spread):
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.concatenate([c + spread * rng.normal(size=(each, dim)) for c in centres])


def same(a, b):
    key = lambda rows: sorted((r.query_id, r["rank"], r.vec_id, round(r.similarity, 4)) for r in rows)
    return key(a.collect()) == key(b.collect())


def test_index_reads_few_cells_and_finds_all(spark, tmp_path):
    rng = np.random.default_rng(7)
    m = clustered(rng, 30, 60, 12, 0.04)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m[rng.permutation(len(m))])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = v.filter("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    old = v.filter("vec_id % 3 < 2")
    index = VectorIndex.build(old, f"{tmp_path}/index", cells=40)
    index.append(v.filter("vec_id % 3 = 2"))
    loaded = VectorIndex.load(spark, f"{tmp_path}/index")
    assert loaded.sizes.sum() == len(rows) and (loaded.radii == index.radii).all()
    for each in ("one", "all"):
        asked = q.limit(1) if each == "one" else q
        found = loaded.search(asked, 5, exclude_self=True)
        assert same(found, retrieval.most_similar(asked, v, 5, exclude_self=True))
        assert each == "all" or loaded.cells_read <= 6
    assert same(loaded.search(q, 5, at_once=7), retrieval.most_similar(q, v, 5))
    near = loaded.search(q, 1000, least=0.9)
    want = retrieval.most_similar(q, v, 1000).filter("similarity >= 0.9")
    assert same(near, want) and near.count() > 1000


def test_index_of_awkward_rows(spark, tmp_path):
    rows = [(i, [float(i % 7) - 3, 1.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, [2.0, 1.0]), (105, [float("inf"), 0.0])]
    v = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id bigint, embedding array<double>, cell string, far int")
    good = v.filter("vec_id < 100")
    index = VectorIndex.build(v, f"{tmp_path}/a")
    q = v.filter("vec_id < 9 or vec_id > 99").withColumnRenamed("vec_id", "query_id")
    # vectors alike in many rows are ties, decided by key
    assert same(index.search(q, 3), retrieval.most_similar(q.filter("query_id < 100"), good, 3))
    assert index.search(q.limit(0)).count() == 0
    empty = VectorIndex.build(v.limit(0), f"{tmp_path}/b")
    assert empty.search(q).count() == 0 and VectorIndex.load(spark, f"{tmp_path}/b").search(q).count() == 0


# ---- shuffles


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101, 5000])
def test_positions_are_a_bijection(spark, n):
    df = spark.range(n)
    for epoch in (0, 1):
        got = df.select("id", splits.permuted(F.col("id"), n, 3, epoch).alias("p")).withColumn("back", splits.permuted(F.col("p"), n, 3, epoch, back=True)).collect()
        assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    if n >= 100:
        a, b = ([r.p for r in df.select(splits.permuted(F.col("id"), n, 3, e).alias("p")).collect()] for e in (0, 1))
        assert sum(x == y for x, y in zip(a, b, strict=True)) < n / 10
        assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.25


def test_an_epoch_resumes_anywhere(spark):
    rows = spark.createDataFrame([(i, f"t{i}", 9) for i in range(50)] + [(7, "again", 9), (None, "none", 9)], "key bigint, text string, position int").drop("position")
    whole = {r.position: (r.key, r.text) for r in splits.shuffled(rows, "key", "text", epoch=2).collect()}
    assert sorted(whole) == list(range(52)) and set(whole.values()) == {(r.key, r.text) for r in rows.collect()}
    part = {r.position: (r.key, r.text) for r in splits.shuffled_from(rows, "key", "text", start=20, count=15, epoch=2).collect()}
    assert part == {p: whole[p] for p in range(20, 35)}
    assert splits.shuffled_from(rows, "key", start=52, count=5).count() == 0 and splits.shuffled(rows.limit(0), "key").count() == 0


# ---- versions


def test_versions_are_joined_where_they_differ(spark, tmp_path):
    from textloom.operators import library
    from textloom.operators.versions import Version

    schema = "k bigint, text string, tags array<string>, note string"
    old = [(i, f"t{i}" if i % 5 else "", ["a"] if i % 3 else [None], None if i % 4 else f"n{i}") for i in range(3000)] + [(None, "no key", [], None)]
    new = [r for r in old if r[0] != 100] + [(3001 + i, "new", None, "x") for i in range(3)]
    new = [(k, "", [], None) if k in (101, 2000) else (k, None, tags, note) if k == 7 else (k, text, tags, note) for k, text, tags, note in new]
    a = Version.save(spark.createDataFrame(old, schema), f"{tmp_path}/old", "k", leaves=60)
    b = Version.save(spark.createDataFrame(new, schema).repartition(5), f"{tmp_path}/new", "k", like=Version.load(spark, f"{tmp_path}/old"))
    b = Version.load(spark, f"{tmp_path}/new")
    assert b.rows().count() == len(new) and a.height >= 3 and len(a.borders) == 59
    key = lambda rows: sorted(map(str, rows))
    x, y = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    assert key(b.difference(a).collect()) == key(library.part_difference(x, y, "k").collect()) and b.leaves_read <= 4
    assert {(r.k, r.change) for r in b.changed(a).collect()} == {(100, "removed"), (101, "changed"), (2000, "changed"), (7, "changed"), (3001, "added"), (3002, "added"), (3003, "added")}
    assert key(b.merged(a).collect()) == key(library.merge_versions(x, y, "k").collect()) and b.leaves_read <= 5
    read = sum(b._some(b.differing(a)).inputFiles().__len__() for _ in (0,))
    assert read < len(b._stored().inputFiles()) / 4
    assert a.differing(a) == [] and a.changed(Version.load(spark, f"{tmp_path}/old")).count() == 0
    other = Version.save(x.withColumn("more", F.lit(1)), f"{tmp_path}/wide", "k", like=a)
    assert len(other.differing(a)) == len({*other._sizes(), *a._sizes()})
    with pytest.raises(ValueError, match="borders"):
        a.differing(Version.save(x, f"{tmp_path}/own", "k", leaves=7))


def test_versions_of_awkward_tables(spark, tmp_path):
    from textloom.operators.versions import Version

    schema = "name string, v string"
    empty = Version.save(spark.createDataFrame([], schema), f"{tmp_path}/0", "name")
    assert empty.rows().count() == 0 and empty.differing(Version.load(spark, f"{tmp_path}/0")) == []
    some = Version.save(spark.createDataFrame([(None, "a"), (None, None), ("x", "a"), ("x", "a"), ("é", None)], schema), f"{tmp_path}/1", "name", like=empty)
    assert {(r.name, r.change) for r in some.changed(empty).collect()} == {(None, "added"), ("x", "added"), ("é", "added")}
    swapped = Version.save(spark.createDataFrame([(None, "a"), (None, None), ("x", "a"), ("é", None)], schema), f"{tmp_path}/2", "name", like=some)
    assert {(r.name, r.change) for r in swapped.changed(some).collect()} == {("x", "changed")}
    with pytest.raises(ValueError, match="strings or whole numbers"):
        Version.save(spark.createDataFrame([(1.5,)], "name double"), f"{tmp_path}/3", "name")


def test_only_wanted_identifiers_are_shuffled(spark):
    """Identifiers that no name or snippet has are dropped before they are dealt out; the results stay."""
    texts = spark.range(50).select(F.col("id").alias("file"), F.concat(F.lit("the "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")).alias("text"))
    names_ = texts.select("file", F.explode(F.array(F.lit("the"), F.lit("w7"), F.lit("no"))).alias("name"))
    found = names.mentions(texts, names_, "file")
    assert sorted((r.file, r.name) for r in found.collect()) == [(i, n) for i in range(50) for n in ("the", "w7")]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    lines_ = texts.select("file", F.posexplode(F.split("text", " ")).alias("line_number", "content"))
    asked = texts.select("file", F.lit(0).alias("comment_id"), F.lit("w7").alias("snippet")).union(spark.createDataFrame([(1, 1, "w9")], "file bigint, comment_id int, snippet string"))
    out = names.first_lines(asked, lines_, "comment_id")
    assert sorted(map(tuple, out.collect())) == sorted([*((i, 0, 8) for i in range(50)), (1, 1, 10)])
    assert "__slots" in out._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_hold_a_bounded_part_of_scores_and_chunks(spark):
    """4096 queries against a batch of 20,000 rows took 655 MB for the scores alone."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from textloom.operators import retrieval

    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(4096, 4)), rng.normal(size=(20_000, 4))
    q /= np.sqrt((q * q).sum(axis=1))[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 4, dtype=np.int32)), pa.array(v.reshape(-1)))], ["key", "v"])
    tracemalloc.start()
    best = {}
    for out in retrieval._scored(SimpleNamespace(value={4: (list(range(4096)), list(q))}), 3, True)([batch]):
        i = out.column("query_id").to_numpy() < 20
        for a, k, s in zip(out.column("query_id").to_numpy()[i].tolist(), out.column("key").to_numpy()[i].tolist(), out.column("similarity").to_numpy()[i].tolist(), strict=True):
            best.setdefault(a, []).append((-round(s, 5), k))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    s = q[:20] @ (v / np.sqrt((v * v).sum(axis=1))[:, None]).T
    for a in range(20):
        s[a, a] = -np.inf
        assert sorted(best[a])[:3] == sorted((-round(x, 5), k) for k, x in enumerate(s[a].tolist()))[:3]

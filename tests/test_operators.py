"""Operators on small tables."""

import json
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from textloom.functions import plugins
from textloom.functions import text as X
from textloom.operators import dedup, grading, library, lines, pairs, retrieval, splits, units
from textloom.plans import flows
from textloom.sources import readers, writers
from textloom.streaming import resume


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


@pytest.mark.parametrize(
    "expr, given, wanted",
    [
        (lambda: X.cut_comments("t"), "a = 1; // x\nb /* y\nz */ c", "a = 1; \nb  c"),
        (lambda: X.expand_tabs("t"), "\ta", "    a"),
        (lambda: X.drop_blank_lines("t"), "a\n \n\nb", "a\nb"),
        (lambda: X.separate_module_args("t"), "module m(a); wire b;\nx; y", "module m(a);\n wire b;\nx; y"),
        (lambda: X.block_text("t"), "block_0:\nfoo", "foo"),
        (lambda: X.body_after_header("t"), "module m(a); assign x=1;", " assign x=1;"),
        (lambda: X.body_after_header("t"), "no header", "no header"),
        (lambda: X.module_header("t"), "module m(a,\n b);\nassign y=a;", "module m(a,\n b);"),
        (lambda: X.header_on_one_line("t"), "module m(a,\n  b);\nassign  y", "module m(a, b);\nassign  y"),
        (lambda: X.override_repeats("t", 5), "repeat(10) x repeat() y", "repeat(5) x repeat(5) y"),
        (lambda: X.squeeze("t"), "a b\n\tc", "abc"),
        (lambda: X.py_strip("t"), "\n\t a b  \n", "a b"),
        (lambda: X.repair_literals("t"), "[null, True, False]", '["", true, false]'),
        (lambda: X.stem("t"), "a.v.txt", "a"),
        (lambda: X.cut_to_tokens("t", 2, "..."), "abcdefghij", "abcdefgh..."),
        (lambda: units.join_parameters("t"), "module m #(A)\n(b);\nx\nendmodule", "module m #(A) (b);\nx\nendmodule"),
        (lambda: units.normalise_modules("t"), "module\nm(a,\nb); x // c", "module m(a,b);\n x"),
        (lambda: F.array_join(X.py_splitlines("t"), "|"), "a\nb\r\n\n", "a|b|"),
        (lambda: F.element_at(X.block_summary(F.array("t")), 1), "Block 0 summary: adds", "adds"),
        (lambda: F.element_at(X.block_summary(F.array("t")), 1), '{"usage":"u","summary":"s"}', "u; s"),
        (lambda: X.json_in("t", "usage STRING, summary STRING")["summary"], 'ok {"usage":"u","summary":"s"} bye', "s"),
        (lambda: pairs.chat(F.col("t"), "sys"), "hi", "[INST] <<SYS>>\nsys\n<</SYS>>\n\nhi [/INST]"),
        (lambda: pairs.chat(F.col("t")), "hi", "[INST] hi [/INST]"),
    ],
)
def test_columns(spark, expr, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(expr().alias("x")).first().x == wanted


def test_sql_functions_agree(spark):
    X.register(spark)
    df = spark.createDataFrame([("a_1 b-c; d",)], "t string")
    df.createOrReplaceTempView("v_sql")
    row = spark.sql("SELECT code_tokens(t) AS a, token_estimate(t) AS b, squeeze(t) AS c, body_after_header(t) AS d FROM v_sql").first()
    assert (row.a, row.b, row.c, row.d) == (["a_1", "b", "c", "d"], 3, "a_1b-c;d", " d")


def test_reply_checks(spark):
    rows = [([True] * 3, ["a"] * 3, [3, 4, 5], True), ([True] * 3, ["a"] * 3, [3, 4, 6], False), ([True], ["a"] * 2, [1, 2], False), ([True] * 2, ["a"] * 2, [4, 4], False), (None, ["a"], [1], False)]
    df = spark.createDataFrame(rows, "comment_exist array<boolean>, comment array<string>, line_number array<int>, ok boolean")
    got = df.select(X.valid_comment_reply(F.struct("comment_exist", "comment", "line_number")).alias("v"), "ok").collect()
    assert all(r.v == r.ok for r in got)


def test_line_tables(spark):
    text = "// a\n// b\nx=1;\ny=2;\n// c\nz=3;\n// end"
    table = lines.line_table(spark.createDataFrame([("f", text)], "file string, text string"))
    code, comments = lines.align_comments(table, F.col("content").startswith("//"))
    assert {r.line_number: r.content for r in code.collect()} == {0: "x=1;", 1: "y=2;", 2: "z=3;"}
    assert {r.line_number: r.content for r in comments.collect()} == {0: "// a\n // b\n", 1: None, 2: "// c\n"}
    assert lines.interleave(code, comments).first().text == "// a\n // b\nx=1;\ny=2;\n// c\nz=3;\n"
    assert lines.count_mismatches(code=code, comments=comments).count() == 0
    assert lines.count_mismatches(code=code, comments=comments.filter("line_number > 0")).first().comments == 2
    assert [r.content for r in lines.lines_at(code, spark.createDataFrame([("f", 2)], "file string, line_number int")).collect()] == ["z=3;"]


def test_chunks(spark):
    code = spark.createDataFrame([("f", i, c) for i, c in enumerate(["module m(a);", "w1", "w2", "w3"])], "file string, line_number int, content string")
    got = sorted((r.chunk_idx, r.page_content, r.splitted_idx) for r in lines.chunks(code, code.limit(0), 2).collect())
    assert got == [(0, "w1\nw2\n", [0, 1]), (1, "w3\n", [2])]
    got = sorted((r.chunk_idx, r.page_content) for r in lines.text_chunks(spark.createDataFrame([("f", "h;a\nb\nc")], "file string, text string"), 2).collect())
    assert got == [(0, "a\nb"), (1, "c")]


def test_parent_chunks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 99, 100, 101, 399, 400, 401, 1234)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in lines.char_chunks(df, "id", "text", 100, 30).collect():
        assert r.chunk == texts[r.id][r.chunk_idx * 70 : r.chunk_idx * 70 + 100]
    for r in lines.parent_chunks(df, "id", "text", borders=False).collect():
        assert r.small in r.large and r.large == texts[r.id][r.large_idx * 300 : r.large_idx * 300 + 400]


def test_history_and_memory(spark):
    blocks = spark.createDataFrame([("f", i, f"c{i}") for i in range(3)], "file string, block int, code string")
    got = {r.block: (r.summary, r.history) for r in lines.running_history(blocks, lambda h, c: f"{len(h)}").collect()}
    assert got == {0: ("0", ""), 1: ("5", "c0\n0\n"), 2: ("10", "c0\n0\nc1\n5\n")}
    assert one(spark, a=list(range(8))).select(lines.ring(F.col("a"), 5).alias("x")).first().x == [3, 4, 5, 6, 7]


def test_alignment_repair(spark):
    t = lambda rows: spark.createDataFrame([(f, i, x) for f, xs in rows.items() for i, x in enumerate(xs)], "file string, line_number int, content string")
    long = [f"x{i} = {i};" for i in range(5000)]
    code = {"f": ["a = 1;", "b = 2;", "c = 3;", "d"], "same": long[:1500], "g": ["q", "r"], "long": long, "swap": ["a", "b", "c"], "many": ["u", "v"] * 1101}
    fixed = {"f": ["a  = 1; b = 2; c = 3;", "d"], "same": ["other"], "g": ["q r s"], "long": [f"{long[0]} {long[1]}", *long[2:]], "swap": ["x"], "many": ["u v"] * 1101}
    notes = {"f": ["n0", "n3"], "same": [f"n{i}" for i in range(1500)], "g": ["n0"], "long": [f"n{i}" for i in range(4999)], "swap": ["n0"], "many": ["n"] * 1101}
    got = {}
    for r in lines.repair_alignment(t(code), t(notes), t(fixed), compat=True, most=1000).collect():
        got.setdefault(r.file, []).append((r.line_number, r.content, r.comment, r.reason))
    got = {k: sorted(v, key=lambda x: x[0] or 0) for k, v in got.items()}
    assert got["f"] == [(0, "a = 1;", "n0", None), (1, "b = 2;", None, None), (2, "c = 3;", None, None), (3, "d", "n3", None)]
    assert [x[1:3] for x in got["same"]] == list(zip(code["same"], notes["same"], strict=True))
    assert [x[1] for x in got["long"]] == long and [x[2] for x in got["long"]] == ["n0", None, *notes["long"][1:]]
    assert got["g"] == [(None, None, None, "the comments don't fit the lines")]
    assert got["swap"] == [(None, None, None, "the corrected text has fewer lines")]
    assert got["many"] == [(None, None, None, "more than 1000 repairs")]
    hits = lines.comment_lines_for(spark.createDataFrame([("f", 7, "b =")], "file string, comment_id int, snippet string"), t(code)).first()
    assert (hits.comment_id, hits.line_number) == (7, 1)


def test_chunks_at_borders(spark):
    from textloom.functions.splitting import chunks

    assert chunks("aa bb cc dd", 5, 2) == ["aa bb", "cc", "dd"] and chunks("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert chunks("p one\n\np two is longer\nline", 12, 0) == ["p one", "p two is", "longer", "line"]
    assert chunks("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and chunks("", 4, 1) == [] and chunks(" \n ", 4, 1) == []
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 300)))
        got = chunks(text, 20, 5)
        assert all(0 < len(c) <= 20 and c in text for c in got) and set("".join(got)) >= set(text.replace("\n", "").replace(" ", ""))
        at = 0  # no word is lost
        for w in text.split():
            if len(w) < 19:
                assert any(w in c for c in got[at:])
    df = spark.createDataFrame([(1, "word " * 200), (2, None)], "id int, text string")
    for r in lines.parent_chunks(df, "id", "text").collect():
        assert r.small in r.large and len(r.large) <= 400 and len(r.small) <= 100


def token_docs(spark, sets):
    return spark.createDataFrame([(i, " ".join(f"t{k}" for k in s)) for i, s in sets.items()], "doc_id bigint, text string")


def test_dedup_policies(spark):
    chain = token_docs(spark, {0: range(20), 1: range(2, 22), 2: range(4, 24), 9: range(100, 109)})
    assert sorted(r.doc_id for r in dedup.first_seen(chain).collect()) == [0, 9]
    close = token_docs(spark, {0: range(400), 1: range(2, 400), 2: range(500, 900)})
    assert sorted(r.doc_id for r in dedup.first_seen(close, mode="lsh").collect()) == [0, 2]
    assert sorted((r.id, r.cluster, r.is_extreme, r.copies) for r in dedup.clusters(chain).collect()) == [(0, 0, True, 2), (1, 0, False, None), (1, 1, True, 2), (2, 1, False, None)]
    assert sorted(r.doc_id for r in dedup.extremes(chain).collect()) == [0, 1, 9]
    alike = token_docs(spark, {0: range(20), 1: range(20), 2: range(1, 21)})
    for keep in (dedup.first_seen, dedup.extremes):
        assert [r.doc_id for r in keep(alike).collect()] == [0]
    short = token_docs(spark, {0: range(9), 1: range(9)})
    assert dedup.first_seen(short).count() == 2
    s = dedup.summary(chain, dedup.clusters(chain)).first()
    assert (s.original, s.clusters, s.clustered, s.extremes, s.kept) == (4, 2, 3, 2, 3)


def walk(near):
    base_of = {}
    for i in sorted(near):
        earlier = sorted(x for x in near[i] if x < i)
        if earlier:
            base_of.setdefault(next((x for x in earlier if x in base_of), earlier[0]), set()).add(i)
    return {(m, b) for b, ms in base_of.items() for m in {b, *ms}}


def test_clusters_against_a_walk_in_order(spark):
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        start = rng.randrange(40)
        sets[i] = frozenset(x for x in range(start, start + 20))
    sets = {i: s for i, s in sets.items() if s not in [sets[j] for j in range(i)]}
    near = {i: {j for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    got = {(r.id, r.cluster) for r in dedup.clusters(token_docs(spark, {i: sorted(s) for i, s in sets.items()})).collect()}
    assert got == walk({i: n for i, n in near.items() if n})
    pairs_ = {(r.id_a, r.id_b) for r in dedup.similar_pairs(token_docs(spark, {i: sorted(s) for i, s in sets.items()})).collect()}
    assert pairs_ == {(i, j) for i in near for j in near[i] if i < j}
    copies = token_docs(spark, {0: range(20), 1: range(20), 2: range(1, 21), 3: range(20)})
    assert [(r.id_a, r.id_b) for r in dedup.similar_pairs(copies).collect()] == [(0, 2)]
    assert sorted((r.id_a, r.id_b, r.both) for r in dedup.similar_pairs(copies, expand=True).collect()) == [(0, 1, 20), (0, 2, 19), (0, 3, 20), (1, 2, 19), (1, 3, 20), (2, 3, 19)]


def test_library(spark):
    meta = spark.createDataFrame([("1", "A", ["B", "C"]), ("2", "B", ["C"]), ("3", "C", []), ("4", "D", ["D"])], "task_id string, code_name string, module_inst_list array<string>")
    assert {r.code_name for r in library.shared_library(meta).collect()} == {"B", "C"}
    got = {r.task_id: r.because for r in library.dependency_impact(meta, spark.createDataFrame([("C",)], "name string")).collect()}
    assert got == {"1": "C", "2": "C"}
    parts = library.round_robin(spark.range(2500), "id").groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in parts) == [(0, 834), (1, 833), (2, 833)]
    again = library.to_document_again(spark.createDataFrame([("x", "removed")], "name string, reason string"), spark.createDataFrame([("x", "impacted"), ("y", "impacted")], "name string, reason string"))
    assert {(r.name, r.reason) for r in again.collect()} == {("x", "removed"), ("y", "impacted")}
    merged = library.merge_metadata(meta.select("task_id", "code_name"), spark.createDataFrame([("1", "Z")], "task_id string, code_name string"))
    assert {r.task_id: r.code_name for r in merged.collect()}["1"] == "Z"


def test_merges(spark):
    schema = "k int, a string, b array<string>, c string, d string, e array<string>"
    new = spark.createDataFrame([(1, "", [], None, "x", [None])], schema)
    old = spark.createDataFrame([(1, "A", ["B"], "C", "D", ["E"])], schema)
    assert tuple(library.merge_versions(new, old, "k").first()) == (1, "A", ["B"], "C", "x", ["E"])
    files = spark.createDataFrame([("p", "x"), ("q", "y")], "name string, path string")
    books = spark.createDataFrame([("p", True, "s")], "name string, summary_in_vecstore boolean, summary string")
    got = {r.name: (r.summary_in_vecstore, r.summary) for r in library.merge_bookkeeping(files, books, ["summary_in_vecstore"]).collect()}
    assert got == {"p": (True, "s"), "q": (False, None)}
    assert library.cleared(books, "summary").first().summary is None
    lists = spark.createDataFrame([("k", 2, ["c"]), ("k", 1, ["a", "b"])], "key string, at int, vals array<string>")
    assert library.concat_lists(lists, "key", "vals").first().vals == ["a", "b", "c"]


def test_matches(spark):
    old = spark.createDataFrame([("m", 1, "a b"), ("m", 2, "a\nc"), ("n", 3, "z")], "name string, task_id int, text string")
    new = spark.createDataFrame([("m", "ac"), ("n", "y")], "name string, text string")
    assert {(r.name, r.old_id, r.impacted) for r in library.match_loosely(new, old).collect()} == {("m", 2, False), ("n", 3, True)}
    meta = spark.createDataFrame([("1", "m", "bad", "t"), ("2", "m", None, "t")], "task_id string, code_name string, error string, code_str string")
    files = spark.createDataFrame([("f", "m", "t")], "file string, name string, text string")
    assert library.match_by_code(files, meta).first().task_id == "2"
    with pytest.raises(Exception, match="metadata has an error"):
        library.attach_metadata(spark.createDataFrame([("1",)], "task_id string"), meta).collect()


def test_containing(spark):
    texts = spark.createDataFrame([(1, "one two three four five six"), (2, "xone two threes"), (3, "a.b"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "two three four five six"), (2, "one two three"), (3, "."), (4, ""), (5, "e t"), (6, None)], "item_id int, text string")
    got, joined = ([tuple(r) for r in library.containing(texts, items, "doc_id", "item_id", sent_items=n).collect()] for n in (1000, 0))
    assert sorted(got) == sorted(joined) and len(got) == len(set(got))
    got = set(got)
    assert got == {(1, 1), (1, 2), (2, 2), (3, 3), (1, 5), (2, 5)}


def test_pass_at_k(spark):
    for n, c, k in [(2, 1, 1), (5, 0, 1), (5, 5, 1), (10, 3, 5), (7, 7, 7), (6, 2, 6)]:
        got = one(spark, n=n, c=c).select(grading.pass_rate(F.col("n"), F.col("c"), k).alias("p")).first().p
        assert got == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k))
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "task_id string, passed boolean")
    assert {r.k: r.pass_at_k for r in grading.pass_at_k(rows, (1, 2)).collect()} == {1: 0.75}


def test_classifier(spark):
    rows = [
        ("Mismatches: 0 in 213 samples", "", False, "passed"),
        ("Mismatches: 207 in 213 samples", "", False, "failed: 207 out of 213 samples."),
        ("Mismatches: 0 in 213 samples", "x syntax error", False, "failed: syntax error."),
        ("", "warning", False, "failed: compile error."),
        ("nothing", "", False, "failed: info string not matched."),
        ("", "", True, "timed out"),
    ]
    df = spark.createDataFrame(rows, "o string, e string, t boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", grading.classify(F.col("o"), F.col("e"), F.col("t"))).collect())


def test_grading_flow(spark):
    problems = spark.createDataFrame([(t, "p", "s", "repeat(3)") for t in "xyz"], "task_id string, prompt string, canonical_solution string, test string")
    samples = spark.createDataFrame([(t, f"{t}{v}", i) for i, (t, v) in enumerate((t, v) for t in "xyz" for v in ("good", "bad"))], "task_id string, completion string, at int")
    runs = {f"{t}good": ("Mismatches: 0 in 9 samples", "", False) for t in "xyz"} | {f"{t}bad": ("Mismatches: 4 in 9 samples", "", False) for t in "xyz"}
    results, rates = flows.grade(samples, problems, plugins.RecordedSimulator(runs), "at", ks=(1, 10))
    assert [(r.k, r.pass_at_k) for r in rates.collect()] == [(1, 0.5)]
    assert [r.passed for r in results.orderBy("task_id", "completion_id").collect()] == [True, False] * 3
    assert grading.never_passed(results).count() == 0 and grading.any_pass(results).filter("passed").count() == 3
    with pytest.raises(ValueError):
        flows.grade(samples.filter("task_id = 'x'"), problems, plugins.RecordedSimulator(runs), "at")
    with pytest.raises(Exception, match="no problem for task"):
        grading.attach_problems(samples, problems.filter("task_id = 'x'")).collect()
    fails = spark.createDataFrame([("t1", True), ("t1", False), ("t2", False), ("t2", False)], "task_id string, passed boolean")
    assert [r.task_id for r in grading.never_passed(fails).collect()] == ["t2"]


def test_checkpoints(spark):
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("x",)], "name string")
    assert grading.latest_checkpoint(names).first().step == 10
    assert grading.latest_checkpoint(names.union(spark.createDataFrame([("completed",)], "name string"))).first().step is None


def test_retrieval(spark):
    index = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 1.0]), (3, 2, [0.0, -2.0]), (4, 2, [0.0, 0.0])], "vec_id int, doc_id int, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.1])], "query_id int, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in retrieval.most_similar(q, index, 2, at_once=1).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert [r.vec_id for r in retrieval.nearest(index, [0.0, -1.0], 1).collect()] == [3]
    assert retrieval.best_above(q, index, 0.9999).count() == 0
    hits = retrieval.most_similar(q, index, 2)
    assert retrieval.parents(hits, index, "vec_id").first().doc_id == 1
    docs = spark.createDataFrame([(1, [1.0, 0.2]), (2, [0.0, 1.0])], "doc_id int, embedding array<double>")
    assert retrieval.progressive(q, docs, index, key="vec_id").first().vec_id == 1


def test_pairs(spark):
    m = spark.createDataFrame([("t", ["module m(a);", "assign x=1;"], "module m(a);", ["b0 text", "b1"], "G", "D")], "task_id string, lines array<string>, module_header string, block_summary array<string>, global_summary_high_level string, global_summary_detailed string")
    got = {r.format: (r.code, r.description) for r in flows.training_pairs(m, "sys", "Write it:").collect()}
    assert got["detailed"][0] == " assign x=1;" and "Write it:\nD\n\nmodule m(a);" in got["detailed"][1]
    assert got["summary_to_blocks"][0] == "\nblock_0: b0 text\n\nblock_1: b1\n" and "G\n\nblock_0" in got["blocks_global_to_code"][1]
    with pytest.raises(Exception, match="header is not in the code"):
        pairs.question_pairs(m.withColumn("module_header", F.lit("other;")), "global_summary_detailed", "s", "q").collect()
    kinds = spark.createDataFrame([("llm1",), ("what",)], "kind string")
    with pytest.raises(Exception, match="unknown prompt type what"):
        kinds.select(pairs.evaluation_prompts(F.col("kind"), "s", F.lit("d"), F.lit("h"))).collect()
    ids, labels = pairs.causal_tokens(F.col("s"), F.col("t"), 1, 2, 3, 3)
    row = one(spark, s=[5, 6, 7], t=[8]).select(ids.alias("i"), labels.alias("l"), pairs.padded(ids, 7, 0).alias("p")).first()
    assert row.i == [1, 5, 6, 8, 2] and row.l == [-100, -100, -100, 8, 2] and row.p == [1, 5, 6, 8, 2, 0, 0]
    alpaca = spark.createDataFrame([("do", "", "r"), ("do", "it", "r")], "instruction string, input string, output string")
    a, b = sorted((r.input for r in pairs.formatted(alpaca, "alpaca").collect()), key=len)
    assert "### Input" not in a and "### Input:\nit" in b
    shots = pairs.few_shot(spark.createDataFrame([("t", "D1"), ("u", "D2")], "task_id string, simple string"), spark.createDataFrame([("u", 0, "c0"), ("t", 1, "c1")], "task_id string, at int, code string"), "simple")
    assert shots.first().examples == "Example: 0 D2\nc0\nExample: 1 D1\nc1\n"


def test_splits(spark):
    df = spark.range(1000)
    assert splits.train_test(df, "id").filter("split = 'eval'").count() == pytest.approx(100, abs=35)
    a = {r.id for r in splits.fraction(df, "id", 0.1).collect()}
    assert len(a) == 100 and a == {r.id for r in splits.fraction(df.repartition(7), "id", 0.1).collect()}


def test_plugins(spark):
    df = spark.createDataFrame([("abcde",), (None,)], "t string")
    assert sorted(str(r.n) for r in df.select(plugins.token_count(plugins.CharTokenizer(), F.col("t")).alias("n")).collect()) == ["2", "None"]
    v = df.limit(1).select(plugins.embedded(plugins.HashEmbedder(8), F.col("t")).alias("v")).first().v
    assert len(v) == 8
    got = plugins.first_valid(spark.createDataFrame([("p",)], "prompt string"), plugins.EchoCompleter(), plugins.StructureChecker(), trials=3).first()
    assert got.completion is None and got.attempts == 3


class Asked:
    """A model that answers by a rule and notes each call in a file."""

    def __init__(self, path, rule):
        self.path, self.rule = str(path), rule

    def complete(self, prompt):
        with open(self.path, "a") as f:
            f.write("x")
        return self.rule(prompt)


def test_models_are_asked_only_after_a_failure(spark, tmp_path):
    good = lambda s: f'so: {{"summary": "{s}", "sure": True}} end'
    cheap = Asked(tmp_path / "cheap", lambda p: good("first") if p < "p3" else "no json")
    fixer = Asked(tmp_path / "fixer", lambda p: good("fixed") if p.startswith("Fix") and spark_free(p) else "{")
    strong = Asked(tmp_path / "strong", lambda p: good(f"strong {p}") if p != "p9" else "{]")
    df = spark.createDataFrame([(f"p{i}",) for i in range(10)], "t string").coalesce(1)
    for f in ("cheap", "fixer", "strong"):
        (tmp_path / f).write_text("")
    got = [r.s for r in df.select(plugins.parsed_with_fallback(F.col("t"), "summary STRING", cheap, fixer, strong, "JSON")["summary"].alias("s")).collect()]
    assert got == ["first"] * 3 + [f"strong p{i}" for i in range(3, 9)] + [None]
    assert [len((tmp_path / f).read_text()) for f in ("cheap", "fixer", "strong")] == [10, 7, 7]


def spark_free(prompt):
    return "p" not in prompt.partition("\n")[2].partition("\n")[2] and prompt.endswith("fixable")


def test_chains_and_retries(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    class Loud:
        def complete(self, prompt):
            return prompt.upper()

    assert [r.reply for r in plugins.Chain("say {x} {n} times", Loud()).run(df).collect()] == ["SAY A 1 TIMES", "SAY  2 TIMES"]
    calls = []

    class Flaky:
        def complete(self, prompt):
            calls.append(prompt)
            if len(calls) < 3:
                raise ConnectionError
            return "ok"

    assert plugins.RetryingCompleter(Flaky(), tries=3, wait=0).complete("p") == "ok" and len(calls) == 3
    calls.clear()
    with pytest.raises(ConnectionError):
        plugins.RetryingCompleter(Flaky(), tries=2, wait=0).complete("p")


def test_exact_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["assign x = 1;", "", None, "élan  vital\n\n中文 it's 12345", "word " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    counted = plugins.token_count(plugins.TiktokenTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), F.col("t"))
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r.n for r in df.select("i", counted.alias("n")).orderBy("i").collect()] == [None if t is None else len(other.encode(t, add_special_tokens=False).ids) for t in texts]


def test_samples_run_in_processes(spark):
    python = plugins.ProcessSimulator([sys.executable, "-m", "py_compile", "{source}"], [sys.executable, "{source}"], ".py", seconds=3, megabytes=2000)
    samples = [("", "print('Mismatches: 0 in 7 samples')", ""), ("n = 1", "print(f'Mismatches: {n} in 7 samples')", ""), ("", "x = (", ""), ("", "import time; time.sleep(60)", ""), ("", "import sys; sys.exit(2)", ""), ("", "x = bytes(3 << 30)", ""), (None, "print('no')", "y = 1")]
    df = spark.createDataFrame([(str(i), *s) for i, s in enumerate(samples)], "task_id string, prompt string, completion string, test string")
    ran = plugins.simulated(df, python)
    got = {r.task_id: r for r in ran.withColumn("result", grading.classify(F.col("stdout"), F.col("stderr"), F.col("timed_out"))).collect()}
    assert [got[str(i)].result for i in range(7)] == ["passed", "failed: 1 out of 7 samples.", "failed: compile error.", "timed out", "failed: compile error.", "failed: compile error.", "failed: info string not matched."]
    assert "SyntaxError" in got["2"].stderr and "MemoryError" in got["5"].stderr and got["4"].stderr == "exit status 2"


RAW = [
    ("0", "// one\nmodule a(input x, output y);\n  b u(x, y);\n  assign y = x;\nendmodule\n"),
    ("1", "module b(input x, output y);\n  assign y = ~x; assign z0 = x; assign z1 = x; assign z2 = x;\nendmodule\nmodule c(input x, output y);\n  assign y = ~x; assign z0 = x; assign z1 = x; assign z2 = x;\nendmodule\n"),
    ("2", "prose"),
    ("3", "module d(input x);\n assign y = (x;\nendmodule"),
]


def test_preprocess_flow(spark):
    c = flows.preprocess(spark.createDataFrame(RAW, "task_id string, text string"))
    assert {r.module_name for r in c.kept.collect()} == {"a", "b"}
    assert {r.code_name: r.module_inst_list for r in c.metadata.collect()} == {"a": ["b"], "b": [], "c": []}
    assert {r.code_name for r in library.shared_library(c.metadata).collect()} == {"b"}
    assert [r.module_name for r in c.rejected.collect()] == ["d"]
    ids = [r.task_id for r in units.separated(spark.createDataFrame(RAW, "task_id string, text string")).orderBy("task_id").collect()]
    assert ids == [0, 1, 2, 3]


def test_sources_and_sinks(spark, tmp_path):
    tree = tmp_path / "repo" / "dir" / "sub"
    tree.mkdir(parents=True)
    (tree / "m.v").write_text(RAW[1][1])
    (tree / "m.txt").write_text("about m")
    (tmp_path / "repo" / "n.sv").write_text("module n; endmodule")
    (tmp_path / "repo" / "skip.py").write_text("x")
    got = {r.name: (r.genre, r.sidecar) for r in readers.code_tree(spark, str(tmp_path / "repo")).collect()}
    assert got == {"m": ("dir, sub", "about m"), "n": ("", None)}
    flat = tmp_path / "flat"
    flat.mkdir()
    for n in "cab":
        (flat / f"{n}.v").write_text(f"text {n}")
    assert [(r.task_id, r.text) for r in readers.flat_directory(spark, str(flat)).orderBy("task_id").collect()] == [("0", "text a"), ("1", "text b"), ("2", "text c")]
    (tmp_path / "p.jsonl").write_text('{"task_id": "t", "prompt": "1"}\n\n{"task_id": "t", "prompt": "2"}\n')
    assert readers.problems(spark, str(tmp_path / "p.jsonl")).first().prompt == "2"
    (tmp_path / "m.json").write_text('{"1": {"code_name": "a", "module_inst_list": ["b"]},\n "2": {"code_name": "c", "error": "e"}}')
    assert {r.task_id: r.error for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()} == {"1": None, "2": "e"}
    table = spark.createDataFrame([("f", 0, 'say "hi",\nthere'), ("f", 1, None)], "file string, line_number int, content string")
    writers.csv_lines(table, str(tmp_path / "csv"))
    back = readers.csv_lines(spark, str(tmp_path / "csv"))
    assert sorted((r.line_number, r.content) for r in back.collect()) == [(0, 'say "hi",\nthere'), (1, None)]
    writers.json_lines(spark.createDataFrame([("t", "c"), (None, None)], "task_id string, completion string"), str(tmp_path / "out"), gzip=True)
    assert readers.json_lines(spark, str(tmp_path / "out"), "task_id string, completion string").count() == 1
    doc = writers.json_document(spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int"), "k").first().document
    assert doc == '{"a":{"n":2},"b":{"n":1}}'
    rows = spark.createDataFrame([(1, "x", 2), (2, None, 1), (1, "y", 1)], "task_id int, text string, at int")
    for order, kept in ((None, "y"), ("at", "x")):
        out = writers.one_file_per_row(rows, f"file://{tmp_path}/files", order=order)
        assert {(r.file, r.bytes) for r in out.collect()} == {("1.v", 1), ("2.v", 0)} and (tmp_path / "files" / "1.v").read_text() == kept
    writers.one_file_per_row(rows.filter("task_id = 2"), f"file://{tmp_path}/files").collect()
    assert sorted(x.name for x in (tmp_path / "files").iterdir()) == ["2.v"]
    meta = spark.createDataFrame([(str(i), f"n{i}", [f"u{i}"], None, 'co"de\n') for i in range(6)], "task_id string, code_name string, module_inst_list array<string>, error string, code_str string")
    for n in (1, 3):
        writers.json_map(meta.repartition(n), str(tmp_path / f"map{n}"), "task_id")
        back = readers.json_map(spark, str(tmp_path / f"map{n}"))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, meta.collect()))
    assert len(json.loads((next((tmp_path / "map1").glob("part-*"))).read_text())) == 6
    writers.part_codes(meta.withColumn("part", F.col("task_id").cast("int") % 2), f"file://{tmp_path}/parts").collect()
    assert sorted(json.loads((tmp_path / "parts" / "part1" / "codes.json").read_text())) == ["n1", "n3", "n5"]
    n = spark.createDataFrame([("m", "t")], "name string, text string")
    writers.documented_package(n.select("name"), n, n, f"file://{tmp_path}/pkg").collect()
    assert (tmp_path / "pkg" / "m" / "m.v").exists() and (tmp_path / "pkg" / "m" / "m.txt").exists()
    (tmp_path / "ctx").mkdir()
    (tmp_path / "ctx" / "guide.a.txt").write_text("l0\nl1\n")
    (tmp_path / "ctx" / "fixed_feature.txt").write_text("no")
    assert [(r.Filetype, r.Line_id, r.Text) for r in readers.system_context(spark, str(tmp_path / "ctx")).collect()] == [("guide", 0, "l0"), ("guide", 1, "l1")]


def test_resumable_documenting(spark, tmp_path):
    src, out, progress = (tmp_path / n for n in ("src", "out", "progress"))
    src.mkdir()

    def start():
        resume.document_new_files(spark, str(src), str(out), str(progress), lambda df: df.select("file", F.length("text").alias("n"))).awaitTermination()

    (src / "a.v").write_text("abc")
    (src / "long.v").write_text("\n" * 300)
    start()
    (src / "b.v").write_text("de")
    start()
    start()
    assert sorted((r.file, r.n) for r in spark.read.parquet(str(out)).collect()) == [("a.v", 3), ("b.v", 2)]
    assert [(r.file, r.lines) for r in spark.read.parquet(f"{out}-long").collect()] == [("long.v", 301)]


def test_loose_matches_of_whole_tables(spark, sf_dir):
    import __spark_entry__ as entry

    rng = random.Random(8)
    texts = ["a b", "ab", "a\nb", "c", "", " ", None, "d e", "x"]
    old = [(rng.choice(["hot", "hot", "hot", "n", None]), i, rng.choice(texts)) for i in range(300)] + [("blank", 900, None), ("blank", 901, None)]
    new = [(rng.choice(["hot", "hot", "n", "gone", None]), rng.choice([*texts, "new", "a  b c"])) for _ in range(300)] + [("blank", "a"), ("blank", None)]
    bare = lambda t: t if t is None else t.replace("\n", "").replace(" ", "").replace("\t", "")
    want = set()
    for name, text in set(new):
        mine = [(i, bare(t)) for n, i, t in old if name is not None and n == name]
        if not mine:
            continue
        hits = [i for i, c in mine if c is not None and c == bare(text)]
        known = text is not None and any(c is not None for _, c in mine)
        want.add((name, text, min(hits) if hits else min(i for i, _ in mine), not hits if known else None))
    joined = library.match_loosely(spark.createDataFrame(new, "name string, text string"), spark.createDataFrame(old, "name string, task_id bigint, text string"))
    got = [tuple(r) for r in joined.select("name", "text", "old_id", "impacted").collect()]
    assert set(got) == want and len(got) == len(want)
    # every document is a new file and a candidate
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").toPandas()
    rows = entry.queries()["q_match_loosely_all"](spark, sf_dir).collect()
    edits = {(r.source, "x" + r.text if r.doc_id % 3 == 0 else f" {r.text}\n" if r.doc_id % 3 == 1 else r.text) for r in d.itertuples()}
    assert len(rows) == len(edits)
    first = {}
    for r in d.sort_values("doc_id").itertuples():
        first.setdefault((r.source, bare(r.text)), r.doc_id)
    assert {r.old_id for r in rows if r.impacted is False} >= {i for i in first.values() if i % 3}


def test_causal_tokens_of_whole_texts(spark, sf_dir, tmp_path):
    from collections import Counter

    import __spark_entry__ as entry

    run = entry.queries()["q_causal_tokens_of_texts"]

    def want(rows):
        out = Counter()
        for conv, turn, role, text in rows:
            s, t = ([b + 3 for b in (x or "").encode()] for x in (role, text))
            s, t = [1, *s][:2048], [*t, 2][:1024]
            out[conv, turn, ",".join(map(str, s + t)), ",".join(map(str, [-100] * len(s) + t))] += 1
        return out

    schema = "conv_id bigint, turn int, role string, text string"
    rows = [(1, 0, "user", "é中 a"), (1, 1, None, "x"), (2, 0, "user", None), (2, 1, "", ""), (3, 0, "r" * 3000, "t" * 1023), (3, 1, "user", "t" * 1024), (3, 2, None, None), (4, 0, "user", "long " * 2000), (4, 0, "user", "é" * 600)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    assert Counter(map(tuple, run(spark, str(tmp_path)).collect())) == want(rows)
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert Counter(map(tuple, run(spark, sf_dir).collect())) == want(map(tuple, given))

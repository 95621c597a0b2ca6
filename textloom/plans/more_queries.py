"""More of the catalogue: operators on tables shaped like those they are meant for, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import plugins
from textloom.functions import text as X
from textloom.operators import grading, library, lines, pairs
from textloom.plans.queries import _LINE_CTE, _OUT, _joined, _lines, _outcomes, _t, query

# --- text ------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(html, '[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g') AS one_line, regexp_replace(html, '^[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g') AS stripped FROM pages")
def q_white_space(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.one_line("html").alias("one_line"), X.py_strip("html").alias("stripped"))


@query("SELECT doc_id, replace(replace(replace(text, 'null', '\"\"'), 'False', 'false'), 'True', 'true') AS repaired, replace(text, 'the', source) AS renamed, replace(replace(replace(text, chr(10), ''), ' ', ''), chr(9), '') = replace(text, ' ', '') AS same FROM documents")
def q_text_repairs(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", X.repair_literals("text").alias("repaired"), X.rename_module("text", "the", F.col("source")).alias("renamed"), (X.squeeze("text") == F.replace("text", F.lit(" "), F.lit(""))).alias("same"))


@query("SELECT doc_id, text IS NULL OR trim(text) IN ('', 'None', 'no_comment') AS blank FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'None' WHEN 2 THEN NULL WHEN 3 THEN ' no_comment ' ELSE text END AS text FROM documents)")
def q_is_blank(spark, sf):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, " ").when(k == 1, "None").when(k == 2, F.lit(None)).when(k == 3, " no_comment ").otherwise(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.coalesce(X.is_blank(t), F.lit(False)).alias("blank"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'u; ' || source WHEN 1 THEN source ELSE lang END AS summary FROM documents")
def q_block_summary(spark, sf):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"usage":"u","summary":"'), "source", F.lit('"}'))).when(k == 1, F.concat(F.lit("Block 0 summary: "), "source")).otherwise(F.concat(F.lit("as provided: "), "lang"))
    return _t(spark, sf, "documents").select("doc_id", F.element_at(X.block_summary(F.array(raw)), 1).alias("summary"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS ok FROM conversations")
def q_reply_validation(spark, sf):
    """Replies made valid, with a gap in their lines, or with lists of unequal length."""
    k = F.col("turn") % 3
    n = F.when(k == 1, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(1)))
    c = F.when(k == 2, F.array("text")).otherwise(F.array("text", "role"))
    reply = F.struct(F.array(F.lit(True), F.lit(False)).alias("comment_exist"), c.alias("comment"), n.alias("line_number"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", X.valid_comment_reply(reply).alias("ok"))


@query("SELECT event_id, CAST(k AS BIGINT) AS k FROM (SELECT event_id, json_extract(props, '$.k') AS k FROM events)")
def q_reply_json(spark, sf):
    e = _t(spark, sf, "events")
    said = F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))
    return e.select("event_id", X.json_in(said, "k BIGINT")["k"].alias("k"))


# --- lines -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINE_CTE} SELECT file, string_agg(content, chr(10) ORDER BY line_number) AS text FROM l GROUP BY 1")
def q_whole_texts(spark, sf):
    return lines.whole_texts(_lines(spark, sf))


@query(f"WITH {_LINE_CTE} SELECT file, CAST(line_number // 3 AS INT) AS line_number, string_agg(content, ' ' ORDER BY line_number) AS content FROM l GROUP BY file, line_number // 3")
def q_group_lines(spark, sf):
    l = _lines(spark, sf).select("file", F.floor(F.col("line_number") / 3).cast("int").alias("line_number"), F.col("line_number").alias("at"), "content")
    return lines.group_lines(l)


@query(f"WITH {_LINE_CTE} SELECT l.file, CAST(l.line_number AS INT) AS line_number, content FROM l JOIN (SELECT DISTINCT doc_id AS file, quality AS line_number FROM labels) w ON l.file = w.file AND l.line_number = w.line_number")
def q_lines_at(spark, sf):
    w = _t(spark, sf, "labels").select(F.col("doc_id").alias("file"), F.col("quality").alias("line_number"))
    return lines.lines_at(_lines(spark, sf), w)


@query(f"WITH {_LINE_CTE}, a AS (SELECT file, count(*) AS a FROM l GROUP BY 1), b AS (SELECT file, count(*) AS b FROM l WHERE content <> '' GROUP BY 1) SELECT coalesce(a.file, b.file) AS file, a, b FROM a FULL JOIN b ON a.file = b.file WHERE a IS DISTINCT FROM b")
def q_count_mismatches(spark, sf):
    l = _lines(spark, sf)
    return lines.count_mismatches(a=l, b=l.filter("content <> ''"))


@query(f"WITH {_LINE_CTE} SELECT file, min(line_number)::INT AS line_number FROM l WHERE contains(content, 'tion') GROUP BY 1")
def q_snippet_lines(spark, sf):
    s = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("comment_id"), F.lit("tion").alias("snippet"))
    return lines.comment_lines_for(s, _lines(spark, sf), compat=True).select("file", "line_number")


@query(f"""WITH {_LINE_CTE}, s AS (SELECT doc_id AS file, regexp_extract(text, '[a-z]+ [a-z]+') AS snippet FROM documents)
    SELECT file, min(line_number)::INT AS line_number FROM l JOIN s USING (file) WHERE snippet <> '' AND regexp_matches(' ' || content || ' ', '[^A-Za-z0-9_$]' || snippet || '[^A-Za-z0-9_$]') GROUP BY 1""")
def q_whole_snippet_lines(spark, sf):
    """The first line that holds the first two words of a text as whole words."""
    s = _t(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("comment_id"), F.regexp_extract("text", "[a-z]+ [a-z]+", 0).alias("snippet")).filter("snippet <> ''")
    return lines.comment_lines_for(s, _lines(spark, sf)).select("file", "line_number")


@query("SELECT conv_id, array_to_string(list_slice(l, greatest(len(l) - 4, 1), len(l)), '|') AS kept FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1)")
def q_ring(spark, sf):
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("all"))
    return c.select("conv_id", F.array_join(lines.ring(F.col("all"), 5), "|").alias("kept"))


@query(f"""WITH b AS (SELECT doc_id AS file, CASE WHEN instr(text, ';') > 0 THEN substr(text, instr(text, ';') + 1) ELSE text END AS t FROM documents),
    l AS (SELECT file, unnest(a) AS content, unnest(range(0, len(a))) AS n FROM (SELECT file, string_split(t, chr(10)) AS a FROM b))
    SELECT file, CAST(n // 10 AS INT) AS chunk_idx, string_agg(content, chr(10) ORDER BY n) AS page_content FROM l GROUP BY 1, 2""")
def q_text_chunks(spark, sf):
    return lines.text_chunks(_t(spark, sf, "documents"), 10, "doc_id")


# --- joins and maintenance -------------------------------------------------------------------------------------------


@query("SELECT l.doc_id, source, quality FROM labels l JOIN documents d USING (doc_id)")
def q_attach_problems(spark, sf):
    s = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("task_id"), "doc_id", "quality")
    p = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), "source")
    return grading.attach_problems(s, p).select("doc_id", "source", "quality")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def q_last_problem(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("task_id"), "doc_id", F.struct("n_chars", "doc_id").alias("o"))
    return grading.last_problems(d, "o").select(F.col("task_id").alias("source"), "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def q_unattempted(spark, sf):
    d = _t(spark, sf, "documents")
    tried = d.join(_t(spark, sf, "labels").filter("quality = 0"), "doc_id").select(F.col("source").alias("task_id"))
    return grading.unattempted(d.select(F.col("source").alias("task_id")).distinct(), tried).select(F.col("task_id").alias("source"))


@query(f"WITH {_OUT}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY doc_id) - 1 AS INT) AS completion_id FROM o) SELECT task_id, string_agg(completion_id || ':' || passed::INT, ',' ORDER BY completion_id) AS results FROM n GROUP BY 1")
def q_sorted_results(spark, sf):
    o = grading.completion_ids(_outcomes(spark, sf).withColumn("result", F.lit("x")), "doc_id")
    r = grading.sorted_results(o)
    return r.select("task_id", F.array_join(F.transform("results", lambda x: F.concat(x["completion_id"].cast("string"), F.lit(":"), x["passed"].cast("int").cast("string"))), ",").alias("results"))


@query(f"WITH {_OUT}, n AS (SELECT task_id, passed, doc_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY doc_id) - 1 AS INT) AS completion_id FROM o) SELECT a.task_id, a.doc_id, b.passed FROM n a JOIN n b ON a.task_id = b.task_id AND a.completion_id = b.completion_id")
def q_attach_results(spark, sf):
    o = grading.completion_ids(_outcomes(spark, sf).withColumn("result", F.lit("x")), "doc_id")
    return grading.attach_results(o.select("task_id", "completion_id", "doc_id"), o).select("task_id", "doc_id", "passed")


@query("SELECT item_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS code_lines, CAST(ceil(length(text) / 4.0) AS BIGINT) AS code_tokens FROM benchmark")
def q_profile(spark, sf):
    b = _t(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt"), F.col("text").alias("canonical_solution"))
    return grading.profile(b.select("task_id"), b).select(F.col("task_id").alias("item_id"), "code_lines", "code_tokens")


@query("SELECT doc_id AS task_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'label' ELSE lang END AS said FROM documents")
def q_merge_metadata(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.col("lang").alias("said"))
    l = _t(spark, sf, "labels").select(F.col("doc_id").alias("task_id"), F.lit("label").alias("said"))
    return library.merge_metadata(d, l)


@query("SELECT name, CASE WHEN bool_or(p = 0) THEN 'long' ELSE 'short' END AS reason FROM (SELECT source AS name, 0 AS p FROM documents WHERE n_chars > 10000 UNION ALL SELECT source, 1 FROM documents WHERE n_chars < 100) GROUP BY 1")
def q_to_document_again(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("name"), "n_chars")
    return library.to_document_again(d.filter("n_chars > 10000").withColumn("reason", F.lit("long")), d.filter("n_chars < 100").withColumn("reason", F.lit("short")))


@query("SELECT o_orderkey AS task_id, o_orderpriority AS code_name, c_mktsegment AS because FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_dependency_impact(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    meta = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("code_name"), F.array("o_orderstatus", "c_mktsegment").alias("module_inst_list"))
    changed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    return library.dependency_impact(meta, changed)


@query("""WITH o AS (SELECT source AS name, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN c ELSE c || 'y' END AS c FROM (SELECT *, replace(replace(replace(text, chr(10), ''), ' ', ''), chr(9), '') AS c FROM documents)),
    n AS (SELECT DISTINCT source AS name, text, replace(replace(replace(text, chr(10), ''), ' ', ''), chr(9), '') AS c FROM documents),
    f AS (SELECT name, min(id) AS id, count(c) AS k FROM o GROUP BY 1), h AS (SELECT name, c, min(id) AS id FROM o GROUP BY 1, 2)
    SELECT n.name, md5(text) AS code, coalesce(h.id, f.id) AS old_id, CASE WHEN text IS NOT NULL AND k > 0 THEN h.id IS NULL END AS impacted FROM n JOIN f ON n.name = f.name LEFT JOIN h ON n.name = h.name AND n.c = h.c""")
def q_match_loosely(spark, sf):
    """All documents against an older state of all, in which every second one ended otherwise."""
    d = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), "text")
    old = d.select(F.col("doc_id").alias("task_id"), "name", F.when(F.col("task_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\ty"))).alias("text"))
    got = library.match_loosely(d.select("name", "text").distinct(), old)
    return got.select("name", F.md5(F.col("text").cast("binary")).alias("code"), "old_id", "impacted")


@query("""WITH o AS (SELECT source AS name, doc_id AS id, replace(replace(replace(text, chr(10), ''), ' ', ''), chr(9), '') AS c FROM documents),
    n AS (SELECT DISTINCT source AS name, CASE doc_id % 3 WHEN 0 THEN 'x' || text WHEN 1 THEN ' ' || text || chr(10) ELSE text END AS text FROM documents),
    f AS (SELECT name, min(id) AS id, count(c) AS k FROM o GROUP BY 1), h AS (SELECT name, c, min(id) AS id FROM o GROUP BY 1, 2)
    SELECT n.name, md5(text) AS code, coalesce(h.id, f.id) AS old_id, CASE WHEN text IS NOT NULL AND k > 0 THEN h.id IS NULL END AS impacted
    FROM n JOIN f ON n.name = f.name LEFT JOIN h ON n.name = h.name AND replace(replace(replace(text, chr(10), ''), ' ', ''), chr(9), '') = h.c""")
def q_match_loosely_all(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), "text")
    k = F.col("doc_id") % 3
    edited = F.when(k == 0, F.concat(F.lit("x"), "text")).when(k == 1, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(F.col("text"))
    got = library.match_loosely(d.select("name", edited.alias("text")), d.withColumnRenamed("doc_id", "task_id"))
    return got.select("name", F.md5(F.col("text").cast("binary")).alias("code"), "old_id", "impacted")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_sidecar(spark, sf):
    f = _t(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".v")).alias("name"))
    s = _t(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("quality").cast("string").alias("text"))
    return library.attach_sidecar(f, s).select("doc_id", F.col("sidecar").cast("int").alias("quality"))


@query("SELECT d.doc_id AS name, l.quality, coalesce(l.toxic = 1, false) AS done FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_merge_bookkeeping(spark, sf):
    files = _t(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.lit("x").alias("path"))
    old = _t(spark, sf, "labels").select(F.col("doc_id").alias("name"), "quality", (F.col("toxic") == 1).alias("done"))
    return library.merge_bookkeeping(files, old, ["done"]).select("name", "quality", "done")


@query("SELECT conv_id, string_agg(role || ',' || text, ',' ORDER BY turn) AS vals FROM conversations GROUP BY 1")
def q_concat_lists(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("at"), F.array("role", "text").alias("vals"))
    return library.concat_lists(c, "conv_id", "vals").select("conv_id", _joined("vals").alias("vals"))


@query("SELECT doc_id, source, CAST(NULL AS VARCHAR) AS lang FROM documents")
def q_cleared(spark, sf):
    return library.cleared(_t(spark, sf, "documents").select("doc_id", "source", "lang"), "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def q_to_index(spark, sf):
    return library.to_index(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT max(CAST(regexp_extract(n, '^checkpoint-(\\d+)$', 1) AS INT)) AS step FROM (SELECT 'checkpoint-' || o_orderkey AS n FROM orders)")
def q_latest_checkpoint(spark, sf):
    return grading.latest_checkpoint(_t(spark, sf, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name")))


# --- prompts ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, quality, '[INST] <<SYS>>' || chr(10) || 's' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || source || chr(10) || chr(10) || lang || ' [/INST]' AS prompt FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, quality, source || chr(10) || chr(10) || lang || chr(10) FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def q_evaluation_prompts(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    kind = F.when(F.col("quality") == 1, "llm1").otherwise("baseline")
    return d.select("doc_id", "quality", pairs.evaluation_prompts(kind, "s", F.col("source"), F.col("lang")).alias("prompt"))


@query("""SELECT ' ' || text AS code, '[INST] <<SYS>>' || chr(10) || 's' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || 'Q' || chr(10) || source || chr(10) || chr(10) || 'a#' || doc_id || '; [/INST]' AS description FROM documents""")
def q_question_pairs(spark, sf):
    header = F.concat(F.lit("a#"), F.col("doc_id").cast("string"), F.lit(";"))
    d = _t(spark, sf, "documents").select(F.array(header, F.col("text")).alias("lines"), header.alias("module_header"), "source")
    return pairs.question_pairs(d, "source", "s", "Q")


@query("SELECT item_id, i AS sample, coalesce(CASE WHEN item_id % 2 = 0 THEN text END, 'simple') AS description FROM benchmark, (SELECT unnest([1, 2, 3]) AS i)")
def q_description_fallback(spark, sf):
    b = _t(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("detail_description"), F.lit("simple").alias("simple_description"))
    return pairs.with_fallback(b, 3).select("item_id", "sample", "description")


@query("SELECT 'Example: ' || string_agg((n - 1) || ' ' || text || chr(10) || 'c' || item_id || chr(10), 'Example: ' ORDER BY n) AS examples FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark)")
def q_few_shot(spark, sf):
    b = _t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("item_id").alias("at"), "text")
    return pairs.few_shot(b, b.select("task_id", "at", F.concat(F.lit("c"), "task_id").alias("code")), "text")


@query("SELECT conv_id, turn, CAST(len(ids) AS INT) AS size, array_to_string(labels, ',') AS labels FROM (SELECT conv_id, turn, list_concat([1], [CAST(turn AS INT), 7])[1:2] AS s, list_concat([CAST(conv_id AS INT)], [2])[1:3] AS t, list_concat(list_concat([1], [CAST(turn AS INT), 7])[1:2], list_concat([CAST(conv_id AS INT)], [2])[1:3]) AS ids, list_concat([-100, -100], list_concat([CAST(conv_id AS INT)], [2])[1:3]) AS labels FROM conversations)")
def q_causal_tokens(spark, sf):
    ids, labels = pairs.causal_tokens(F.array(F.col("turn").cast("int"), F.lit(7)), F.array(F.col("conv_id").cast("int")), 1, 2, 2, 3)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.size(ids).alias("size"), _joined(labels).alias("labels"))


@query()
def q_causal_tokens_of_texts(spark, sf):
    source, target = (plugins.token_ids(plugins.ByteTokenizer(), F.col(c)) for c in ("role", "text"))
    ids, labels = pairs.causal_tokens(source, target, 1, 2)
    return _t(spark, sf, "conversations").select("conv_id", "turn", _joined(ids).alias("ids"), _joined(labels).alias("labels"))


@query("SELECT doc_id AS task_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS code, CAST(ceil(length(source) / 4.0) AS BIGINT) AS summary, CAST(ceil(length(text) / 4.0) + ceil(length(source) / 4.0) AS BIGINT) AS llm1 FROM documents")
def q_token_totals(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("code"), F.col("source").alias("summary"), F.array("lang").alias("block_summary"), F.array("lang").alias("comments"), X.lines("text").alias("lines"))
    return pairs.token_totals(d).select("task_id", "code", "summary", "llm1")


@query("SELECT conv_id AS file, 's' || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def q_reverse_prompts(spark, sf):
    c = _t(spark, sf, "conversations")
    notes = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_number"), F.col("text").alias("content"))
    return pairs.reverse_prompts(notes.select("file").distinct().withColumn("summary", F.lit("s")), notes)

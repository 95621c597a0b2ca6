"""The query catalogue over the driver's tables, each over its whole table, with the equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import dedup, grading, library, lines, pairs, retrieval, splits, units
from textloom.operators.vector_index import VectorIndex
from textloom.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB's spelling of the code tokens of a text.
_TOKENS = "list_filter(regexp_split_to_array(text, '[^A-Za-z_0-9]'), lambda t: length(t) > 0)"
_LINES = "string_split(text, chr(10))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.line_table(_t(spark, sf, "documents"), "doc_id")


def _joined(c: str, sep: str = ","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


_LINE_CTE = f"l AS (SELECT doc_id AS file, unnest(range(0, len(a))) AS line_number, unnest(a) AS content FROM (SELECT doc_id, {_LINES} AS a FROM documents))"


# --- tokens and text functions ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS tokens FROM documents")
def q_tokens_per_doc(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(X.code_tokens("text")).cast("bigint").alias("tokens"))


@query(f"SELECT doc_id, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS tokens FROM documents")
def q_distinct_tokens(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(X.token_set("text")).cast("bigint").alias("tokens"))


@query(f"SELECT doc_id FROM documents WHERE len({_TOKENS}) >= 10")
def q_min_token_gate(spark, sf):
    return _t(spark, sf, "documents").filter(X.enough_tokens("text")).select("doc_id")


@query(rf"SELECT doc_id, array_to_string(list_filter({_LINES}, lambda x: regexp_matches(x, '[^\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]')), chr(10)) AS text FROM documents")
def q_drop_blank_lines(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.drop_blank_lines("text").alias("text"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents WHERE ceil(length(text) / 4.0) <= 16384 AND length(text) - length(replace(text, chr(10), '')) + 1 <= 200")
def q_len_filter(spark, sf):
    d = _t(spark, sf, "documents").filter(X.fits("text") & X.few_lines("text"))
    return d.select("doc_id", X.token_estimate("text").alias("tokens"), F.size(X.lines("text")).cast("bigint").alias("lines"))


@query(r"""SELECT page_id, replace(html, chr(9), '    ') AS tabs, regexp_replace(regexp_replace(html, '//[^\n]*', '', 'g'), '/\*(?s:.*?)\*/', '', 'g') AS comments,
    regexp_replace(html, 'repeat\([0-9]*\)', 'repeat(7)', 'g') AS repeats, replace(replace(replace(html, chr(10), ''), ' ', ''), chr(9), '') AS squeezed FROM pages""")
def q_text_cleanup(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.expand_tabs("html").alias("tabs"), X.cut_comments("html").alias("comments"), X.override_repeats("html", 7).alias("repeats"), X.squeeze("html").alias("squeezed"))


@query(r"""SELECT page_id, CASE WHEN instr(html, ';') > 0 THEN substr(html, instr(html, ';') + 1) ELSE html END AS body,
    CASE WHEN instr(html, ':' || chr(10)) > 0 THEN substr(html, instr(html, ':' || chr(10)) + 2) ELSE html END AS block,
    CASE WHEN instr(html, ';') > 0 THEN substr(html, 1, instr(html, ';')) END AS header, string_split(url, '.')[1] AS stem FROM pages""")
def q_html_cut(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.body_after_header("html").alias("body"), X.block_text("html").alias("block"), X.module_header("html").alias("header"), X.stem("url").alias("stem"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour, strftime(ts, '%H-%M') AS minute FROM events")
def q_event_stamps(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.hour_stamp("ts").alias("hour"), X.minute_stamp("ts").alias("minute"))


@query("SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_events_hourly(spark, sf):
    return _t(spark, sf, "events").groupBy(X.hour_stamp("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.json_in("props", "k BIGINT")["k"].alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 400) || '...' END AS text FROM documents")
def q_token_budget(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.cut_to_tokens("text", 100, "...").alias("text"))


@query("SELECT sum(length(text)) / pow(1024.0, 3) AS gib FROM documents")
def q_corpus_size(spark, sf):
    return splits.corpus_gib(_t(spark, sf, "documents"))


# --- near duplicates -------------------------------------------------------------------------------------------------

_NODES = f"""d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT doc_id, list_sort(list_distinct(w)) AS t FROM d WHERE len(w) >= 10),
    n AS (SELECT min(doc_id) AS id, t FROM s GROUP BY t), x AS (SELECT id, len(t) AS n, unnest(t) AS tok FROM n),
    p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.tok = b.tok AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
    j AS (SELECT id_a, id_b, c, na, nb FROM p WHERE 5 * c >= 4 * (na + nb - c))"""


@query(f"WITH {_NODES} SELECT id_a, id_b, c AS shared, round(c / (na + nb - c), 6) AS jaccard FROM j")
def q_jaccard_pairs(spark, sf):
    """Links between the smallest ids of equal token sets; membership is q_token_set_members."""
    p = dedup.similar_pairs(_t(spark, sf, "documents"))
    return p.select("id_a", "id_b", F.col("both").cast("bigint").alias("shared"), "jaccard")


@query(f"WITH {_NODES} SELECT s.doc_id, n.id AS representative FROM s JOIN n ON s.t = n.t")
def q_token_set_members(spark, sf):
    return dedup.token_set_members(_t(spark, sf, "documents")).toDF("doc_id", "representative")


@query(f"WITH {_NODES} SELECT doc_id FROM documents EXCEPT (SELECT s.doc_id FROM s JOIN n ON s.t = n.t WHERE s.doc_id <> n.id UNION SELECT id_b FROM j)")
def q_dedup_first_seen(spark, sf):
    return dedup.first_seen(_t(spark, sf, "documents")).select("doc_id")


@query()
def q_dedup_lsh(spark, sf):
    return dedup.first_seen(_t(spark, sf, "documents"), mode="lsh").select("doc_id")


#: The ordered rule, document by document: each takes its first earlier neighbour that is a base, else the first makes a base.
_WALK = f"""WITH RECURSIVE {_NODES}, near AS (SELECT id_b AS id, id_a AS x FROM j UNION ALL SELECT s.doc_id, n.id FROM s JOIN n ON s.t = n.t AND s.doc_id <> n.id),
    nb AS MATERIALIZED (SELECT id, list(x ORDER BY x) AS xs, row_number() OVER (ORDER BY id) AS k FROM near GROUP BY id),
    walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS base, CAST([] AS BIGINT[]) AS bases
        UNION ALL SELECT k, id, base, list_append(bases, base) FROM (SELECT nb.k, nb.id, walk.bases, coalesce(list_filter(nb.xs, lambda x: list_contains(walk.bases, x))[1], nb.xs[1]) AS base FROM walk JOIN nb ON nb.k = walk.k + 1)),
    c AS (SELECT id, base AS cluster, false AS is_extreme, CAST(NULL AS BIGINT) AS copies FROM walk WHERE k > 0 UNION ALL SELECT base, base, true, count(*) + 1 FROM walk WHERE k > 0 GROUP BY base)"""


@query(f"{_WALK} SELECT * FROM c")
def q_dedup_clusters(spark, sf):
    """The clusters of the ordered rule."""
    return dedup.clusters(_t(spark, sf, "documents"))


@query(f"{_WALK} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM c GROUP BY id HAVING NOT bool_or(is_extreme))")
def q_dedup_extremes(spark, sf):
    return dedup.extremes(_t(spark, sf, "documents")).select("doc_id")


@query(f"{_WALK} SELECT n AS original, clusters, clustered, extremes, n - clustered + extremes AS kept FROM (SELECT count(*) AS n FROM documents), (SELECT count(DISTINCT cluster) AS clusters FROM c), (SELECT count(*) AS clustered, count(*) FILTER (WHERE e) AS extremes FROM (SELECT id, bool_or(is_extreme) AS e FROM c GROUP BY id))")
def q_dup_summary(spark, sf):
    d = _t(spark, sf, "documents")
    return dedup.summary(d, dedup.clusters(d))


@query(f"{_WALK} SELECT item AS base_index, cluster, is_extreme, copies FROM (SELECT id AS item, cluster, is_extreme, copies FROM c)")
def q_dedup_keyed_clusters(spark, sf):
    """Documents known by two columns whose order is that of their ids."""
    d = _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("repo_name"), (F.col("doc_id") % 100).alias("path"), "doc_id", "text")
    first = d.agg(F.min("doc_id")).first()[0]
    return dedup.keyed_clusters(d, "repo_name", "path").select((F.col("base_index") + first).alias("base_index"), (F.col("cluster") + first).alias("cluster"), "is_extreme", "copies")


# --- lines and windows -----------------------------------------------------------------------------------------------


@query(f"WITH {_LINE_CTE} SELECT file AS doc_id, CAST(line_number AS INT) AS line_number, content FROM l")
def q_doc_lines(spark, sf):
    return _lines(spark, sf).withColumnRenamed("file", "doc_id")


@query(f"WITH {_LINE_CTE} SELECT file, CAST(line_number // 10 AS INT) AS batch, CAST(min(line_number) AS INT) AS first_line, CAST(max(line_number) AS INT) AS last_line, string_agg(content, chr(10) ORDER BY line_number) AS text FROM l GROUP BY 1, 2")
def q_line_blocks10(spark, sf):
    return lines.batches(_lines(spark, sf), 10)


@query(f"WITH {_LINE_CTE} SELECT file, CAST(line_number // 5 AS INT) AS batch, CAST(min(line_number) AS INT) AS first_line, CAST(max(line_number) AS INT) AS last_line, string_agg(content, chr(10) ORDER BY line_number) AS text FROM l GROUP BY 1, 2")
def q_batches5(spark, sf):
    return lines.batches(_lines(spark, sf), 5)


@query(f"""WITH {_LINE_CTE} SELECT file, CAST(line_number AS INT) AS line_number,
    coalesce(string_agg(line_number || ': ' || content, chr(10)) OVER (PARTITION BY file ORDER BY line_number ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), '') AS above,
    coalesce(string_agg(line_number || ': ' || content, chr(10)) OVER (PARTITION BY file ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING), '') AS below FROM l""")
def q_context_window(spark, sf):
    return lines.context(_lines(spark, sf)).select("file", "line_number", "above", "below")


_ALIGN = f"""{_LINE_CTE}, c AS (SELECT *, content LIKE 'A%' AS is_comment FROM l),
    n AS (SELECT *, CAST(coalesce(sum(CASE WHEN is_comment THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS n FROM c),
    code AS (SELECT file, n AS line_number, content FROM n WHERE NOT is_comment),
    note AS (SELECT file, n, string_agg(content || chr(10), ' ' ORDER BY line_number) AS note FROM n WHERE is_comment GROUP BY 1, 2)"""


@query(f"WITH {_ALIGN} SELECT code.file, line_number, note AS content FROM code LEFT JOIN note ON code.file = note.file AND line_number = note.n")
def q_comment_alignment(spark, sf):
    """Lines that begin with "A" stand for comments, as the texts are prose."""
    return lines.align_comments(_lines(spark, sf), F.col("content").startswith("A"))[1]


@query(f"WITH {_ALIGN} SELECT code.file, string_agg(coalesce(note, '') || content || chr(10), '' ORDER BY line_number) AS text FROM code LEFT JOIN note ON code.file = note.file AND line_number = note.n GROUP BY 1")
def q_interleave(spark, sf):
    return lines.interleave(*lines.align_comments(_lines(spark, sf), F.col("content").startswith("A")))


@query(f"""WITH {_LINE_CTE}, h AS (SELECT file, min(line_number) + 1 AS start FROM l WHERE instr(content, ',') > 0 GROUP BY 1),
    b AS (SELECT l.file, line_number - coalesce(start, 0) AS pos, content FROM l LEFT JOIN h ON l.file = h.file WHERE line_number >= coalesce(start, 0))
    SELECT file, CAST(pos // 10 AS INT) AS chunk_idx, string_agg(content || chr(10), '' ORDER BY pos) AS page_content, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS splitted_idx FROM b GROUP BY 1, 2""")
def q_code_chunks(spark, sf):
    """A comma stands for the semicolon that ends a header."""
    code = _lines(spark, sf).withColumn("content", F.translate("content", ",;", ";,"))
    c = lines.chunks(code, code.limit(0))
    return c.select("file", "chunk_idx", F.translate("page_content", ";,", ",;").alias("page_content"), _joined("splitted_idx").alias("splitted_idx"))


@query("""WITH a AS (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 100) / 300.0), 1) AS INT) AS n FROM documents),
    big AS (SELECT doc_id, i AS large_idx, substr(text, CAST(i * 300 + 1 AS BIGINT), 400) AS large FROM (SELECT doc_id, text, unnest(range(0, n)) AS i FROM a)),
    m AS (SELECT *, CAST(greatest(ceil((length(large) - 30) / 70.0), 1) AS INT) AS n FROM big)
    SELECT doc_id, CAST(large_idx AS INT) AS large_idx, CAST(i AS INT) AS small_idx, substr(large, CAST(i * 70 + 1 AS BIGINT), 100) AS small FROM (SELECT *, unnest(range(0, n)) AS i FROM m)""")
def q_parent_chunks(spark, sf):
    return lines.parent_chunks(_t(spark, sf, "documents"), "doc_id", "text", borders=False).select("doc_id", "large_idx", "small_idx", "small")


@query("SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS memory FROM conversations")
def q_memory_window(spark, sf):
    return lines.memory(_t(spark, sf, "conversations")).select("conv_id", "turn", "memory")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def q_last_n_turns(spark, sf):
    return lines.latest(_t(spark, sf, "conversations"), 3).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, coalesce(string_agg(role || chr(10) || text || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def q_running_history(spark, sf):
    b = _t(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("block"), F.col("role").alias("code"), F.col("text").alias("summary"))
    return lines.running_history(b).select(F.col("file").alias("conv_id"), F.col("block").alias("turn"), "history")


@query(f"WITH {_LINE_CTE} SELECT file, CAST(line_number AS INT) AS line_number, content FROM l WHERE line_number BETWEEN 3 AND 7")
def q_line_range(spark, sf):
    return lines.lines_between(_lines(spark, sf), 3, 7)


# --- joins, sets, parts ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def q_label_join(spark, sf):
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_unlabelled(spark, sf):
    return library.not_done(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_labelled_semi(spark, sf):
    return library.only(_t(spark, sf, "documents"), _t(spark, sf, "labels").filter("quality = 0"), "doc_id").select("doc_id")


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE n_chars > 20000")
def q_except(spark, sf):
    d = _t(spark, sf, "documents")
    return library.difference(d.filter("lang = 'en'"), d.filter("n_chars > 20000"), "source")


@query("SELECT source, lang FROM documents WHERE n_chars > 3000 INTERSECT SELECT source, lang FROM documents WHERE n_chars < 300")
def q_intersect(spark, sf):
    d = _t(spark, sf, "documents")
    return library.intersection(d.filter("n_chars > 3000"), d.filter("n_chars < 300"), "source", "lang")


@query("""SELECT coalesce(a.k, b.k) AS source, CASE WHEN a.k IS NOT NULL THEN 'a' ELSE 'b' END AS only_in
    FROM (SELECT DISTINCT source AS k FROM documents WHERE n_chars > 12000) a FULL JOIN (SELECT DISTINCT source AS k FROM documents WHERE n_chars < 60) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def q_part_difference(spark, sf):
    d = _t(spark, sf, "documents")
    return library.part_difference(d.filter("n_chars > 12000"), d.filter("n_chars < 60"), "source")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % ((SELECT count(*) FROM documents) // 1000 + 1) AS INT) AS part FROM documents")
def q_round_robin_parts(spark, sf):
    return library.round_robin(_t(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT source, CAST(n // 100000 AS INT) AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY 1, 2")
def q_source_ids(spark, sf):
    return library.ids_by_name(_t(spark, sf, "documents"), "source", "doc_id").select("source", "part", _joined("ids").alias("ids"))


@query("SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def q_name_collision_last_wins(spark, sf):
    d = _t(spark, sf, "documents")
    return library.last_by_key(d.select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("""SELECT DISTINCT a.p_brand AS code_name FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand <> a.p_brand AND b.p_size = a.p_size)""")
def q_shared_library(spark, sf):
    """Brands that another brand names: each names the brands of its sizes."""
    p = _t(spark, sf, "part").select("p_brand", "p_size").distinct()
    by_size = p.groupBy("p_size").agg(F.collect_set("p_brand").alias("module_inst_list"))  # brands are few
    meta = p.join(by_size, "p_size").select(F.col("p_brand").alias("code_name"), "module_inst_list")
    return library.shared_library(meta).select("code_name").distinct()


@query("""SELECT n.doc_id, coalesce(nullif(n.t, ''), o.text) AS text, coalesce(n.l, o.lang) AS lang
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' || text END AS t, CASE WHEN doc_id % 2 = 0 THEN lang END AS l FROM documents) n LEFT JOIN documents o USING (doc_id)""")
def q_merge_blank_fallback(spark, sf):
    d = _t(spark, sf, "documents")
    new = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("x"), "text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return library.merge_versions(new, d.select("doc_id", "text", "lang"), "doc_id")


@query("""SELECT doc_id AS key, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations""")
def q_union_all(spark, sf):
    d, b, c = _t(spark, sf, "documents"), _t(spark, sf, "benchmark"), _t(spark, sf, "conversations")
    return splits.union_all(d.select(F.col("doc_id").alias("key"), "text"), b.select(F.col("item_id").alias("key"), "text"), c.select(F.col("conv_id").alias("key"), "text"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q_contamination(spark, sf):
    return library.containing(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"), "doc_id", "item_id").select("doc_id", "item_id")


# --- grading ---------------------------------------------------------------------------------------------------------


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("task_id"), (F.col("quality") == 1).alias("passed"), "doc_id", "n_chars")


_OUT = "o AS (SELECT source AS task_id, quality = 1 AS passed, doc_id, n_chars FROM documents JOIN labels USING (doc_id)), t AS (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM o GROUP BY 1)"


def _passk(k: int) -> str:
    return f"""WITH {_OUT}, r AS (SELECT n, CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0
        ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}.0::DOUBLE / i)), lambda a, b: a * b) END AS p FROM t)
        SELECT {k} AS k, round(avg(p), 9) AS pass_at_k FROM r HAVING min(n) >= {k}"""


def _add_passk(k: int) -> None:
    def f(spark, sf):
        return grading.pass_at_k(_outcomes(spark, sf), (k,)).select("k", F.round("pass_at_k", 9).alias("pass_at_k"))

    f.__name__ = f"q_passk_{k}"
    query(_passk(k))(f)


for _k in (1, 5, 10):
    _add_passk(_k)


@query(f"WITH {_OUT} SELECT task_id, n, c FROM t")
def q_task_totals(spark, sf):
    return grading.totals(_outcomes(spark, sf))


@query(f"WITH {_OUT} SELECT task_id FROM t WHERE c = 0")
def q_fail_all(spark, sf):
    return grading.never_passed(_outcomes(spark, sf))


@query(f"WITH {_OUT}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY doc_id) - 1 AS INT) AS completion_id FROM o) SELECT task_id, bool_or(passed) AS passed, coalesce(CAST(min_by(doc_id, completion_id) FILTER (WHERE passed) AS VARCHAR), '') AS completion FROM n GROUP BY 1")
def q_any_pass(spark, sf):
    r = grading.completion_ids(_outcomes(spark, sf).withColumn("completion", F.col("doc_id").cast("string")), "doc_id")
    return grading.any_pass(r)


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS completion_id FROM conversations")
def q_completion_ids(spark, sf):
    return grading.completion_ids(_t(spark, sf, "conversations"), "turn", "conv_id").select("conv_id", "turn", "completion_id")


@query("SELECT item_id, CAST(s AS INT) AS sample FROM benchmark, (SELECT unnest(range(1, 6)) AS s)")
def q_fanout_k(spark, sf):
    return grading.fan_out(_t(spark, sf, "benchmark"), 5).select("item_id", "sample")


@query(f"""WITH {_OUT}, e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM o), b AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 9)), 8) AS INT) AS bin, passed FROM o, e)
    SELECT bin, count(*) AS total, count(*) FILTER (WHERE NOT passed) AS failures, round(count(*) FILTER (WHERE NOT passed) / (count(*) + 1e-6::DOUBLE), 9) AS rate FROM b GROUP BY 1""")
def q_pass_hist_shared_edges(spark, sf):
    r = grading.failure_rates(_outcomes(spark, sf), "n_chars", ~F.col("passed"))
    return r.withColumn("rate", F.round("rate", 9))


@query("""WITH e AS (SELECT min(n_chars)::DOUBLE AS lo0, max(n_chars)::DOUBLE AS hi0 FROM documents), b AS (SELECT CAST(least(floor((n_chars - lo0) / ((hi0 - lo0) / 10)), 9) AS INT) AS bin, lo0, (hi0 - lo0) / 10 AS w FROM documents, e)
    SELECT bin, round(min(lo0 + bin * w), 4) AS lo, round(min(lo0 + (bin + 1) * w), 4) AS hi, count(*) AS n FROM b GROUP BY 1""")
def q_histogram(spark, sf):
    h = grading.histogram(_t(spark, sf, "documents"), "n_chars")
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


@query("""WITH g AS (SELECT source, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, round(a, 9) AS accuracy, round((SELECT avg(a) FROM g), 9) AS macro FROM g""")
def q_accuracy_by_subject(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return grading.accuracy_by_subject(d, "source", "quality", "toxic").select("source", F.round("accuracy", 9).alias("accuracy"), F.round("macro", 9).alias("macro"))


@query(r"""SELECT event_id, CASE WHEN value > 900 THEN 'timed out' WHEN event_id % 7 = 0 THEN 'failed: syntax error.' WHEN event_id % 7 = 1 THEN 'failed: compile error.' WHEN event_id % 7 = 2 THEN 'failed: info string not matched.'
    WHEN event_id % 5 = 0 THEN 'passed' ELSE 'failed: ' || (event_id % 5) || ' out of 213 samples.' END AS result FROM events""")
def q_classify_runs(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.col("event_id") % 7
    out = F.when(kind == 2, F.lit("nothing")).otherwise(F.concat(F.lit("Mismatches: "), (F.col("event_id") % 5).cast("string"), F.lit(" in 213 samples")))
    err = F.when(kind == 0, F.lit("x: syntax error")).when(kind == 1, F.lit("x: warning")).otherwise(F.lit(""))
    return e.select("event_id", grading.classify(out, err, F.col("value") > 900).alias("result"))


# --- retrieval -------------------------------------------------------------------------------------------------------

_COS = """c AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS similarity FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM c)"""


def _queries_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf, "embeddings")
    return e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e


@query(f"WITH {_COS} SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 3")
def q_cosine_top3(spark, sf):
    """Queries are the rows whose id is divisible by 20; all rows are searched."""
    q, e = _queries_of(spark, sf)
    return retrieval.most_similar(q, e, 3, exclude_self=True)


@query(f"WITH {_COS} SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 3")
def q_indexed_top3(spark, sf):
    """The same by a stored index, to which the last rows are appended."""
    q, e = _queries_of(spark, sf)
    path, last = new_path(spark, "vector-index"), F.col("vec_id") % 10 == 9
    VectorIndex.build(e.filter(~last), path).append(e.filter(last))
    return VectorIndex.load(spark, path).search(q, 3, exclude_self=True)


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine_of_neighbours(spark, sf):
    """Each vector with that of the next id."""
    e = _t(spark, sf, "embeddings")
    joined = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return joined.select("vec_id", F.round(retrieval.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


_PARENTS = """WITH v AS (SELECT vec_id, vec_id // 8 AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    x AS (SELECT vec_id, doc_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
    m AS (SELECT doc_id, list(m ORDER BY i) AS m FROM (SELECT doc_id, i, avg(x) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT q.vec_id AS query_id, m.doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, m.m), 5) DESC, m.doc_id) AS r FROM v q, m WHERE q.vec_id % 20 = 0),
    c AS (SELECT query_id, t.doc_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 5) AS similarity FROM t JOIN v USING (doc_id) JOIN v q ON q.vec_id = query_id WHERE r = 1)"""


@query(f"{_PARENTS} SELECT query_id, doc_id, chunk_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM c) WHERE rank <= 2")
def q_progressive(spark, sf):
    """Documents of eight vectors each, known by their mean: the best document of each query, then its two best vectors."""
    q, e = _queries_of(spark, sf)
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 8).alias("doc_id"), "embedding")
    means = chunks.select("doc_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("embedding"))
    return retrieval.progressive(q, means, chunks, k=2).select("query_id", "doc_id", "chunk_id", "similarity", "rank")


@query(f"WITH {_COS} SELECT query_id, rank, vec_id, similarity FROM r WHERE rank = 1 AND similarity >= 0.5")
def q_top1_threshold(spark, sf):
    q, e = _queries_of(spark, sf)
    return retrieval.best_above(q, e, 0.5, exclude_self=True)


# --- prompts, pairs, splits ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, '[INST] <<SYS>>' || chr(10) || 'You write code.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || source || chr(10) || text || ' [/INST]' AS input, CAST(quality AS VARCHAR) AS output FROM documents JOIN labels USING (doc_id)""")
def q_prompt_pairs(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    p = d.select("doc_id", F.col("quality").cast("string").alias("code"), pairs.chat(F.concat("source", F.lit("\n"), "text"), "You write code.").alias("description"))
    return p.select("doc_id", F.col("description").alias("input"), F.col("code").alias("output"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q: ' || text ELSE '' END AS input, text AS output, CAST(length(CASE WHEN role = 'user' THEN 'Q: ' || text ELSE '' END) + length(text) AS INT) AS length FROM conversations""")
def q_sft_formats(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("Q: "), "text")).otherwise(F.lit("")).alias("input"), F.col("text").alias("output"))
    return pairs.with_length(c)


@query("""SELECT conv_id, turn, replace(string_split(t, chr(10) || '<bot>: ')[1], '<human>: ', '') AS input, string_split(t, chr(10) || '<bot>: ')[2] AS output
    FROM (SELECT conv_id, turn, '<human>: ' || role || chr(10) || '<bot>: ' || text AS t FROM conversations)""")
def q_chat_split(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("<human>: "), "role", F.lit("\n<bot>: "), "text").alias("text"))
    return c.select("conv_id", "turn", *pairs.chip2_columns("text"))


@query("""SELECT doc_id, string_agg(chr(10) || 'block_' || (i - 1) || ': ' || b || chr(10), '' ORDER BY i) AS blocks FROM (SELECT doc_id, unnest(a) AS b, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) GROUP BY 1""")
def q_block_list(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", pairs.block_list(X.lines("text")).alias("blocks"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def q_ordered_concat(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(lines.ordered_concat("turn", "text", "\n").alias("text"))


def _mark(seed: int) -> str:
    return f"CAST('0x' || substr(md5(doc_id || ':{seed}'), 1, 15) AS BIGINT)"


@query(f"SELECT doc_id, CASE WHEN {_mark(0)} % 10 < 1 THEN 'eval' ELSE 'train' END AS split FROM documents")
def q_train_test(spark, sf):
    return splits.train_test(_t(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents")
def q_split_by_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("split"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_mark(42)}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.25)")
def q_fraction(spark, sf):
    return splits.fraction(_t(spark, sf, "documents").select("doc_id"), "doc_id", 0.25)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def q_head(spark, sf):
    return splits.head(_t(spark, sf, "documents").select("doc_id", "n_chars"), 20, F.desc("n_chars"), "doc_id")


@query()
def q_bordered_chunks(spark, sf):
    """Small chunks cut at paragraphs, lines and words; tests hold the splitter against its rules."""
    return lines.parent_chunks(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id", "large_idx", "small_idx", "large", "small")


# --- relational checks -----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q_star_pricing(spark, sf):
    l = _t(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_star_nation_revenue(spark, sf):
    l, o, c, n = (_t(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_star_top_orders(spark, sf):
    return splits.head(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


# --- shuffles and signatures -------------------------------------------------------------------------------------------------

_SHUFFLE = """WITH RECURSIVE s AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents), c AS (SELECT n, a, (n + a - 1) // a AS b FROM s),
    w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, 0 AS steps FROM documents UNION ALL SELECT doc_id, l2 * b + r2, steps + 1 FROM (SELECT doc_id, steps, b, x // b AS l0, x % b AS r0,
        (l0 + CAST('0x' || substr(md5(r0 || ':42:1:0'), 1, 8) AS BIGINT)) % a AS l1, (r0 + CAST('0x' || substr(md5(l1 || ':42:1:1'), 1, 8) AS BIGINT)) % b AS r1,
        (l1 + CAST('0x' || substr(md5(r1 || ':42:1:2'), 1, 8) AS BIGINT)) % a AS l2, (r1 + CAST('0x' || substr(md5(l2 || ':42:1:3'), 1, 8) AS BIGINT)) % b AS r2 FROM w, c WHERE steps = 0 OR x >= n)),
    p AS (SELECT doc_id, x AS position FROM w, c WHERE steps > 0 AND x < n)"""


@query(f"{_SHUFFLE} SELECT doc_id, position FROM p")
def q_shuffled(spark, sf):
    """The second epoch of a shuffle."""
    return splits.shuffled(_t(spark, sf, "documents").select("doc_id"), "doc_id", epoch=1)


@query(f"{_SHUFFLE} SELECT doc_id, position FROM p WHERE position >= (SELECT n // 2 FROM c)")
def q_shuffle_resumed(spark, sf):
    """The second half of the same epoch, from its positions."""
    d = _t(spark, sf, "documents").select("doc_id")
    n = d.count()
    return splits.shuffled_from(d, "doc_id", start=n // 2, count=n, epoch=1)


_SIGNED = """WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS t FROM documents),
    s AS (SELECT doc_id, list_transform(range(1, 13), lambda s: list_min(list_transform(t, lambda x: md5(x || ':' || s)))) AS sig FROM t WHERE len(t) > 0)"""


def _signed(spark, sf):
    return dedup.md5_signatures(_t(spark, sf, "documents"), 12).withColumnRenamed("id", "doc_id")


@query(f"{_SIGNED} SELECT doc_id, array_to_string(sig, ',') AS sig FROM s")
def q_signatures(spark, sf):
    """MinHash signatures of twelve permutations."""
    return _signed(spark, sf).select("doc_id", _joined("sig").alias("sig"))


@query(f"""{_SIGNED}, b AS (SELECT doc_id, unnest(list_transform(range(0, 3), lambda i: i || ':' || array_to_string(sig[i * 4 + 1 : i * 4 + 4], ':'))) AS band FROM s)
    SELECT band, min(doc_id) AS first, count(*) AS n FROM b GROUP BY 1 HAVING count(*) > 1""")
def q_lsh_buckets(spark, sf):
    """Buckets of the bands of these signatures that hold several documents."""
    b = _signed(spark, sf).select("doc_id", F.explode(dedup.band_columns(F.col("sig"), 3, 4)).alias("band"))
    return b.groupBy("band").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")

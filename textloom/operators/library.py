"""The shared library of a corpus, its parts, and comparison with an older state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import word_runs
from textloom.operators.joins import splittable_join
from textloom.operators.units import numbered, numbered_within
from textloom.storage import materialise


def merge_metadata(*tables: DataFrame) -> DataFrame:
    """Metadata by task_id; the last table that has a task wins."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("__seq", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in ("task_id", "__seq")]
    return out.groupBy("task_id").agg(F.max_by(F.struct(*cols), "__seq").alias("s")).select("task_id", "s.*")


def ids_by_name(meta: DataFrame, name: str = "code_name", key: str = "task_id", per_list: int = 100_000) -> DataFrame:
    """The ids of each name in order: name, part, ids. A name of more than ``per_list`` ids has several parts, from 0, so no list grows with the corpus. Rows without an id are left out."""
    at = numbered_within(meta.select(F.col(name).alias(name), F.col(key).alias("item")).filter("item is not null"), name, "item", name="nth")
    lists = at.withColumn("part", F.floor(F.col("nth") / per_list).cast("int")).groupBy(name, "part").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    return lists.select(name, "part", "ids")


def shared_library(meta: DataFrame) -> DataFrame:
    """Modules that another module instantiates: meta (task_id, code_name, module_inst_list)."""
    used = meta.select(F.col("code_name").alias("owner"), F.explode("module_inst_list").alias("inst")).distinct()
    return meta.join(used, (F.col("code_name") == F.col("inst")) & (F.col("code_name") != F.col("owner")), "left_semi")


def round_robin(rows: DataFrame, *order: str, size: int = 1000) -> DataFrame:
    """Parts of about ``size``: the position modulo (n // size + 1)."""
    n = rows.agg((F.floor(F.count(F.lit(1)) / size) + 1).alias("__parts"))
    return numbered(rows, *order, name="__at").join(F.broadcast(n)).withColumn("part", F.pmod("__at", "__parts").cast("int")).drop("__at", "__parts")


def attach_metadata(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of each file; a task that failed its checks stops the query."""
    joined = files.join(meta, "task_id")
    return joined.withColumn("code_name", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("metadata has an error: "), "error"))).otherwise(F.col("code_name")))


def match_by_code(files: DataFrame, meta: DataFrame) -> DataFrame:
    """For each file (file, name, text) the task of that name and text, without an error if one such is there, else the first. Files meet one row for each name and text, by its digest; without a name or text they meet none."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias("__code")
    first = meta.select(F.col("code_name").alias("name"), digest("code_str"), F.struct(F.col("error").isNotNull().alias("bad"), "task_id", "error").alias("t"))
    first = first.filter("name is not null and __code is not null").groupBy("name", "__code").agg(F.min("t").alias("t"))
    joined = splittable_join(files.withColumn("__code", digest("text")), first, "name", "__code")
    return joined.select(*files.columns, "t.task_id", "t.error")


def match_loosely(new: DataFrame, old: DataFrame) -> DataFrame:
    """Old tasks (name, task_id, text) for new files (name, text): the one of equal code (white space aside), or else the first of the name, then impacted.

    Whether it is impacted is null where the new text is, or where the name's old texts all are. Codes meet by their digests, so no name's files meet all its tasks.
    """
    digest = lambda c: F.sha2(X.squeeze(c), 256)
    o = old.select("name", F.col("task_id").alias("old_id"), digest("text").alias("code"))
    first = o.groupBy("name").agg(F.min("old_id").alias("first_id"), F.count("code").alias("codes"))
    same = o.filter("code IS NOT NULL").groupBy("name", "code").agg(F.min("old_id").alias("hit"), F.lit(True).alias("same"))
    n = new.select("name", "text").distinct().withColumn("code", digest("text")).join(first, "name").join(same, ["name", "code"], "left")
    impacted = F.when(F.col("code").isNotNull() & (F.col("codes") > 0), F.col("same").isNull())
    return n.select("name", "text", F.when(F.col("same"), F.col("hit")).otherwise(F.col("first_id")).alias("old_id"), impacted.alias("impacted"))


def dependency_impact(meta: DataFrame, changed: DataFrame) -> DataFrame:
    """Modules of which a dependency was added to or removed from the library, with the first such: changed (name)."""
    deps = meta.select("task_id", "code_name", F.posexplode("module_inst_list").alias("at", "inst"))
    hit = deps.join(changed.select(F.col("name").alias("inst")).distinct(), "inst")
    return hit.groupBy("task_id", "code_name").agg(F.min_by("inst", "at").alias("because"))


def to_document_again(removed: DataFrame, impacted: DataFrame) -> DataFrame:
    """Names of both kinds (name, reason); one that is in both keeps the first."""
    both = removed.select("name", "reason", F.lit(0).alias("__p")).unionByName(impacted.select("name", "reason", F.lit(1).alias("__p")))
    return both.groupBy("name").agg(F.min_by("reason", "__p").alias("reason"))


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def intersection(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def part_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two parts has, and which; null is a key like any other."""
    told = a.select(key, F.lit(1).alias("__in")).union(b.select(key, F.lit(2).alias("__in")))
    sides = told.groupBy(key).agg(F.min("__in").alias("__least"), F.max("__in").alias("__most"))
    return sides.filter("__least = __most").select(key, F.when(F.col("__least") == 1, F.lit("a")).otherwise(F.lit("b")).alias("only_in"))


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in order: what a file of that name, or a map with that key, would hold."""
    # an aggregate, which each task begins on its own rows; rows without an order come before all others
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("__last"))
    return last.select(*keys, "__last.*").select(*rows.columns)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is chosen, each once."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def to_index(rows: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows that the stored index lacks, to be appended to it."""
    return not_done(rows, indexed, key)


def cleared(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def blank_to_null(c: Column, kind: str) -> Column:
    """None of the spellings of a missing value: null, "", [], [null, ...], {}."""
    if kind == "string":
        return F.when(c != "", c)
    if kind.startswith("array"):
        return F.when((F.size(c) > 0) & F.element_at(c, 1).isNotNull(), c)
    if kind.startswith("map"):
        return F.when(F.size(c) > 0, c)
    return c


def merge_versions(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows, each missing value filled from the old row of the same key."""
    kinds = dict(new.dtypes)
    o = old.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    joined = new.join(o, key, "left")
    return joined.select(key, *[F.coalesce(blank_to_null(F.col(c), kinds[c]), F.col(f"__{c}")).alias(c) for c in new.columns if c != key])


def csv_paths(files: DataFrame, code_dir: str, comment_dir: str, name: str = "name") -> DataFrame:
    """Where the line tables of each file lie: csv_code and csv_comment."""
    table = F.concat(X.stem(name), F.lit(".csv"))
    return files.withColumns({"csv_code": F.concat(F.lit(code_dir.rstrip("/") + "/"), table), "csv_comment": F.concat(F.lit(comment_dir.rstrip("/") + "/"), table)})


def merge_bookkeeping(files: DataFrame, old: DataFrame, flags: list[str], key: str = "name") -> DataFrame:
    """Scanned files with what the old records say of them; files that are new get their flags as false."""
    joined = files.select(key, *[c for c in files.columns if c != key and c not in old.columns]).join(old, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def attach_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The text beside each file, by the stem of its name."""
    s = sidecars.select(X.stem("name").alias("__stem"), F.col("text").alias("sidecar"))
    return files.join(s, X.stem(files["name"]) == F.col("__stem"), "left").drop("__stem")


def concat_lists(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Lists of one key joined to one, in the order of ``at``."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", values))), lambda x: x[values])).alias(values))


#: Up to so many items their anchors, 16 bytes each, are sent to all tasks; more meet the texts in a join.
SENT_ITEMS = 1_000_000


def containing(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text_col: str = "text", anchor: int = 4, sent_items: int = SENT_ITEMS) -> DataFrame:
    """Which texts contain which items, as substrings: text_id, item_id. Empty items are in no text.

    An item's anchor is its second word to the one before its last, up to ``anchor`` words: these stand whole in any text that contains it. Texts meet items by
    the hashes of the word runs of the same number of words, and those that meet are compared in full. Items too short for an anchor are
    compared with every text; they must be few, and are broadcast in batches of bounded size.
    """
    from textloom.session import ship

    spark = texts.sparkSession
    ship(spark)
    i = items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("item")).filter(F.col("item") != "")
    t = texts.select(F.col(text_id).alias("text_id"), F.col(text_col).alias("text"))
    kinds = {"text_id": dict(t.dtypes)["text_id"], "item_id": dict(i.dtypes)["item_id"]}

    def anchored(batches):
        import pyarrow as pa

        for b in batches:
            n, h = word_runs.anchors(b.column("item"), anchor)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(n.astype("int32")), pa.array(h.view("int64"))], ["item_id", "n", "h"])

    known = materialise(i.mapInArrow(anchored, f"item_id {kinds['item_id']}, n int, h bigint"), "anchors")
    long_ = known.filter("n > 0")
    lengths = sorted(r.n for r in long_.select("n").distinct().collect())  # at most ``anchor`` numbers
    if long_.count() <= sent_items:
        table = long_.toArrow().combine_chunks()
        hit = t.mapInArrow(_meeting(spark.sparkContext.broadcast(table), lengths), f"text_id {kinds['text_id']}, item_id {kinds['item_id']}")
    else:
        runs = t.mapInArrow(_run_rows(lengths), f"text_id {kinds['text_id']}, n int, h bigint")
        hit = runs.join(long_, ["n", "h"]).select("text_id", "item_id")
    found = hit.distinct().join(t, "text_id").join(i, "item_id").filter(F.contains("text", "item")).select("text_id", "item_id")
    short = known.filter("n = 0").join(i, "item_id").select("item_id", "item")
    per_batch = 10_000
    n = short.count()
    for b in range(-(-n // per_batch)):
        part = short.filter(F.pmod(F.xxhash64("item_id"), F.lit(-(-n // per_batch))) == b)
        found = found.union(t.join(F.broadcast(part), F.contains("text", "item")).select("text_id", "item_id"))
    return found.select(F.col("text_id").alias(text_id), F.col("item_id").alias(item_id))


def _meeting(sent, lengths: list[int]):
    """Pairs of a text and an item whose anchor's hash is among those of the text's runs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = sent.value
        n, h = table.column("n").to_numpy(), table.column("h").to_numpy().view(np.uint64)
        by = {}
        for k in lengths:
            at = np.nonzero(n == k)[0]
            at = at[np.argsort(h[at], kind="stable")]
            by[k] = (h[at], at)
        for b in batches:
            for first, texts in word_runs.pieces(b.column("text")):
                words, sizes = word_runs.word_hashes(texts)
                for k, (hashes, at) in by.items():
                    runs, doc = word_runs.run_hashes(words, sizes, k)
                    low, high = np.searchsorted(hashes, runs, "left"), np.searchsorted(hashes, runs, "right")
                    some = np.nonzero(low < high)[0]
                    if not len(some):
                        continue
                    size = high[some] - low[some]
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[some], size)
                    pairs = np.unique(np.stack([np.repeat(doc[some], size) + first, at[place]]), axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("text_id").take(pa.array(pairs[0])), table.column("item_id").combine_chunks().take(pa.array(pairs[1]))], ["text_id", "item_id"])

    return run


def _run_rows(lengths: list[int]):
    """The distinct run hashes of each text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for first, texts in word_runs.pieces(b.column("text"), 1_000_000):
                words, sizes = word_runs.word_hashes(texts)
                for k in lengths:
                    runs, doc = word_runs.run_hashes(words, sizes, k)
                    order = np.lexsort((runs, doc))
                    runs, doc = runs[order], doc[order]
                    new = np.ones(len(runs), bool)
                    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
                    runs, doc = runs[new], doc[new]
                    yield pa.RecordBatch.from_arrays([b.column("text_id").take(pa.array(doc + first)), pa.array(np.full(len(runs), k, np.int32)), pa.array(runs.view(np.int64))], ["text_id", "n", "h"])

    return run

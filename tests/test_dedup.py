"""The exact join of token sets: its index, its stars, awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup, token_index
from textloom.operators.token_index import Scheme


def token_docs(spark, sets):
    return spark.createDataFrame([(i, " ".join(f"t{k}" for k in s)) for i, s in sets.items()], "doc_id bigint, text string")


def alike(x, y, percent=80):
    return 100 * len(x & y) >= percent * len(x | y)


def bounded_sets(rng, size, words=150, low=10, high=70):
    """Sets over few words, none of them rare, and near copies of some."""
    sets = {}
    for i in range(size):
        if i and rng.random() < 0.5:
            s = set(sets[rng.randrange(i)])
            for _ in range(rng.randrange(12)):
                (s.add if rng.random() < 0.5 else s.discard)(rng.randrange(words))
            if len(s) < 10:
                s |= set(range(10))
        else:
            s = set(rng.sample(range(words), rng.randint(low, high)))
        sets[i] = s
    return sets


def batch_of(sets):
    return pa.RecordBatch.from_pydict({"n": pa.array([len(s) for s in sets], pa.int32()), "tokens": pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))})


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 90])
def test_similar_sets_share_a_key_at_every_level(percent):
    rng = random.Random(percent)
    sets = list(bounded_sets(rng, 220).values()) + [{1}, {1, 2}, {2}, set(range(500)), set(range(3, 500))]
    bits = 14
    often = np.bincount(token_index.slots(np.concatenate([np.array(sorted(s)) for s in sets]), bits), minlength=1 << bits).astype(np.uint32)
    o = token_index._Ordered(batch_of(sets), often, bits, percent)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j], percent)]
    assert len(links) > 50
    levels = set()
    for level in (1, 2, 3):
        keys = {}
        for c in range(int(o.reach.max()) + 1):
            g = token_index.groups_of(c, level, percent)
            scheme = Scheme(level, g) if g else Scheme(1, 1)
            levels.add(scheme.level)
            doc, key = o.keys(np.nonzero((o.own <= c) & (o.reach >= c))[0], c, scheme)
            for d, k in zip(doc.tolist(), key.tolist(), strict=True):
                keys.setdefault((c, d), set()).add(k)
        for i, j in links:
            c = int(max(o.own[i], o.own[j]))
            assert keys[c, i] & keys[c, j]
    assert levels == {1, 2, 3}


def test_higher_levels_bring_fewer_strangers_together():
    """In a bounded vocabulary every token is common, and so is every prefix; combinations aren't."""
    rng = random.Random(1)
    sets = [set(rng.sample(range(4000), 64)) for _ in range(1500)]
    bits = 14
    often = np.bincount(token_index.slots(np.concatenate([np.array(sorted(s)) for s in sets]), bits), minlength=1 << bits).astype(np.uint32)
    o = token_index._Ordered(batch_of(sets), often, bits, 80)
    met = []
    for level in (1, 2, 3):
        doc, key = o.keys(np.arange(len(sets)), 6, Scheme(level, token_index.groups_of(6, level, 80)))
        rows = np.empty(len(key), token_index.PLAIN)
        rows["key"], rows["node"] = key, doc * 4 + 3
        met.append(sum(len(a) for a, _ in token_index._pairs(rows, False)))
    assert met[0] > 8 * met[1] > 16 * met[2], met


def test_pairs_of_a_key():
    kind = token_index.POSTING
    rows = np.array([(1, 4 * n + 2 * (n != 5) + (n % 2), n // 3) for n in range(6)] + [(2, 4 * 9 + 3, 3), (2, 4 * 5, 1)], kind)
    got = {(a, b) for x, y in token_index._pairs(rows, True) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a in range(3) for b in range(3, 6)} | {(5, 9)}
    plain = rows[["key", "node"]].astype(token_index.PLAIN)
    got = {(a, b) for x, y in token_index._pairs(plain, False) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for b in (1, 3, 5) for a in range(b)} | {(5, 9)}


@pytest.mark.parametrize("levels", [(1,), (1, 2), (2, 3)])
def test_join_in_a_bounded_vocabulary(spark, monkeypatch, levels):
    monkeypatch.setattr(token_index, "LEVELS", levels)
    monkeypatch.setattr(dedup, "BLOCK", 8)
    sets = bounded_sets(random.Random(3), 260)
    df = token_docs(spark, sets)
    pairs = {(j, i) for i in sets for j in range(i) if alike(sets[i], sets[j])}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    got = dedup.similar_pairs(df).collect()
    want = {(i, j) for i, j in pairs if sets[i] != sets[j] and first[frozenset(sets[i])] == i and first[frozenset(sets[j])] == j}
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want) > 100
    assert all(r.both == len(sets[r.id_a] & sets[r.id_b]) for r in got)
    assert {r.doc_id for r in dedup.first_seen(df).collect()} == set(sets) - {j for _, j in pairs}


def test_first_seen_in_a_large_group_of_near_copies(spark):
    """One group of texts that are all alike but none equal: the pairs compared grow with its size, not with its square."""
    rng = random.Random(6)
    base = [f"t{k}" for k in range(60)]
    docs = {i: [*rng.sample(base, 58), f"own{i}"] for i in range(800)} | {i: [f"x{i}_{k}" for k in range(20)] for i in range(900, 950)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id bigint, text string")
    sets = {i: set(t) for i, t in docs.items()}
    kept = {i for i in sets if not any(j < i and alike(sets[i], sets[j]) for j in sets)}
    for mode in ("exact", "lsh"):
        got = {r.doc_id for r in dedup.first_seen(df, mode=mode).collect()}
        assert got == kept if mode == "exact" else got >= kept and len(got - kept) < 20  # the other mode may miss links
    nodes = dedup._nodes(df, "doc_id", "text")
    labels = dedup._labels(nodes, 80)
    told = nodes.known.select("node").join(labels.withColumn("gone", F.lit(True)), "node", "left").select("node", F.col("gone").isNull().alias("open"))
    assert labels.count() > 700 and dedup._met(nodes, 80, "exact", told, False).count() < 2 * 800
    # all pairs are links; most come from the stars, whose sets are dealt to blocks
    assert dedup.similar_pairs(df).count() == sum(alike(sets[i], sets[j]) for i in range(800) for j in range(i))
    stars = dedup._labels(nodes, 80, 3).groupBy("label").count().orderBy(F.desc("count")).first()
    assert stars["count"] > 500


def test_nearest_pairs_of_each():
    kind = np.dtype([("a", "<i8"), ("b", "<i8"), ("apart", "<f8")])
    rows = np.array([(1, 9, 0.3), (2, 9, 0.1), (3, 9, 0.2), (2, 9, 0.1), (4, 9, 0.2), (1, 8, 0.5), (1, 8, 0.5), (2, 8, 0.1)], kind)
    best, more = token_index._nearest(rows, 2)
    assert [(int(a), int(b)) for a, b, _ in best] == [(2, 8), (1, 8), (2, 9), (3, 9)] and more.tolist() == [9]
    assert token_index._nearest(rows[:0], 2)[0].tolist() == []


def test_what_the_nearest_leave_open_is_settled(spark, monkeypatch):
    """Only one candidate each at first, and no hubs: the rest comes in the second round."""
    sets = bounded_sets(random.Random(3), 200, words=60, low=20, high=40)
    df = token_docs(spark, sets)
    monkeypatch.setattr(dedup, "NEAREST", 1)
    monkeypatch.setattr(dedup, "_labels", lambda nodes, percent: spark.createDataFrame([], "node bigint, label bigint"))
    kept = {i for i in sets if not any(alike(sets[i], sets[j]) for j in range(i))}
    assert {r.doc_id for r in dedup.first_seen(df).collect()} == kept


def test_repeated_and_null_ids(spark):
    text = lambda *ranges: " ".join(f"t{k}" for r in ranges for k in r)
    a, near, other, third = text(range(20)), text(range(1, 21)), text(range(50, 80)), text(range(51, 80))
    rows = [(1, a), (1, a), (2, near), (2, near), (3, other), (3, near), (4, near), (4, "short"), (5, other), (5, third), (None, a), (None, other), (6, None), (7, ""), (8, text(range(100, 120))), (8, text(range(101, 120)))]
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id bigint, text string, node int, id string, row int")
    pairs = [(r.id_a, r.id_b, r.both) for r in dedup.similar_pairs(df).collect()]
    assert sorted(pairs) == [(1, 2, 19), (3, 5, 29)]  # each link once, none between two texts of one id
    left = dedup.first_seen(df)
    assert left.columns == df.columns
    # 2 goes with all of its rows; 3 has a text of its own, 4 a short one; of 5 both texts are copies
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in left.collect())) == sorted((i is None, i or 0) for i, _ in rows if i not in (2, 5))
    none = df.limit(0)
    assert dedup.first_seen(none).count() == dedup.similar_pairs(none).count() == dedup.clusters(none).count() == dedup.extremes(none).count() == 0
    assert sorted((r.id, r.node) for r in dedup.token_set_members(df.filter("doc_id < 3 or doc_id is null")).collect()) == [(1, 1), (1, 1), (2, 2), (2, 2)]
    names = spark.createDataFrame([("b", a), ("a", near), ("c", None)], "doc_id string, text string")
    assert [(r.id_a, r.id_b) for r in dedup.similar_pairs(names).collect()] == [("a", "b")]
    assert sorted(r.doc_id for r in dedup.first_seen(names).collect()) == ["a", "c"]


def test_other_thresholds(spark):
    sets = bounded_sets(random.Random(11), 150)
    df = token_docs(spark, sets)
    for percent in (60, 85):
        got = {(r.id_a, r.id_b) for r in dedup.similar_pairs(df, percent, expand=True).collect()}
        assert got == {(j, i) for i in sets for j in range(i) if alike(sets[i], sets[j], percent)}


def test_lsh_bands_follow_the_threshold(spark):
    assert dedup.bands_and_rows(80) == (28, 9) and dedup.bands_and_rows(85) == (21, 12)
    for percent in range(50, 100, 5):
        bands, rows = dedup.bands_and_rows(percent)
        assert bands * rows <= dedup.PERMUTATIONS and 0.95 <= 1 - (1 - (percent / 100) ** rows) ** bands
    rng = random.Random(2)
    sets = {}
    for k in range(120):  # pairs of similarity 0.82
        s = rng.sample(range(10**6), 100)
        sets |= {2 * k: s, 2 * k + 1: s[:90] + rng.sample(range(10**6), 10)}
    found = dedup.similar_pairs(token_docs(spark, sets), mode="lsh").count()
    assert 110 <= found <= 120


def test_outlines_lose_no_similar_pair():
    rng = random.Random(9)
    sets = list(bounded_sets(rng, 150, words=4000, low=10, high=900).values()) + [{1}, set(range(3000)), set(range(200, 3000))]
    tokens = [np.sort(token_index.mix(np.array(sorted(s))).view(np.int64)) for s in sets]
    sizes = np.array([len(s) for s in sets])
    words, length = token_index.outlines_of(np.concatenate(tokens), sizes)
    ends = np.cumsum(length)
    o = token_index.Outlines(sizes, np.arange(len(sets)), ends - length, length, words.view(np.uint64))
    i, j = np.tril_indices(len(sets), -1)
    for percent in (50, 80, 90):
        fits = o.may_be_similar(i, o, j, percent)
        true = np.array([alike(sets[x], sets[y], percent) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
        assert not (true & ~fits).any() and fits.sum() < 3 * true.sum() + 100
    o.owner[:] = 1
    assert not o.may_be_similar(i, o, j, 50).any()


def test_outlines_that_are_joined(spark, monkeypatch):
    """More nodes than are sent: their numbers and outlines are joined, with the same results."""
    sets = bounded_sets(random.Random(3), 120)
    df = token_docs(spark, sets)
    monkeypatch.setattr(dedup, "SENT_NODES", 0)
    pairs = {(j, i) for i in sets for j in range(i) if alike(sets[i], sets[j])}
    assert {(r.id_a, r.id_b) for r in dedup.similar_pairs(df, expand=True).collect()} == pairs


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 62, 300)
    b[:200] = a[:200]
    m = token_index.minhashes(np.concatenate([np.sort(a), np.sort(b)]), np.array([300, 300]), 1000)
    assert abs((m[0] == m[1]).mean() - 0.5) < 0.06


def test_md5_signatures(spark):
    """Against hashing word by word; a text is split and a word hashed once, so no plan repeats that for each permutation."""
    from hashlib import md5

    rows = [(1, "a b_1, a"), (2, ""), (3, None), (4, "-- é"), (5, " ".join(f"w{i}" for i in range(3000))), (6, "b_1"), (7, "xéy")]
    out = dedup.md5_signatures(spark.createDataFrame(rows, "doc_id bigint, text string"), 5)
    words = {i: set(re.findall("[A-Za-z0-9_]+", t or "")) for i, t in rows}
    assert {r.id: r.sig for r in out.collect()} == {i: [min(md5(f"{x}:{s}".encode()).hexdigest() for x in w) for s in range(1, 6)] for i, w in words.items() if w}
    assert "split" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_more_nodes_than_are_sent(spark, monkeypatch, tmp_path):
    """Pairs are still dropped where they are made, by mapped outlines, and tokens get their nodes once."""
    rng = random.Random(8)
    base = [set(rng.sample(range(4000), rng.randint(15, 60))) for _ in range(20)]
    sets = {i: (x := rng.choice(base)) - set(rng.sample(sorted(x), rng.randint(0, len(x) // 5))) for i in range(100)}
    for name in ("SENT_NODES", "SENT_WORDS"):
        monkeypatch.setattr(dedup, name, 10)
    nodes = dedup._nodes(token_docs(spark, sets), "doc_id", "text")
    assert isinstance(nodes.outlines().value, token_index.MappedOutlines)
    assert nodes.tokens() is nodes.tokens()
    table = nodes.known.select("node", "n", F.xxhash64("id").alias("owner"), "outline")
    mapped = token_index.map_outlines(table, str(tmp_path / "o"), nodes.count, 4)
    rows = table.orderBy("node").toArrow().combine_chunks()
    held = token_index.Outlines.of(*(rows.column(c).combine_chunks() for c in ("n", "owner", "outline")))
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(nodes.count), np.arange(nodes.count)))
    apart = np.zeros((2, len(a)))
    assert (mapped.may_be_similar(a, mapped, b, 80, apart[0]) == held.may_be_similar(a, held, b, 80, apart[1])).all() and (apart[0] == apart[1]).all()
    assert len(mapped.files) > 1
    gone = {i for i in sets for k in range(i) if len(sets[i]) >= 10 and len(sets[k]) >= 10 and alike(sets[i], sets[k])}
    assert {r.doc_id for r in dedup.first_seen(token_docs(spark, sets)).collect()} == set(sets) - gone

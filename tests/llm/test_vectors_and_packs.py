"""Packing, hard negatives and whitening against brute force over the same rows."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import hard_negatives, packing, queries, vectors, whitening

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- packing


def check_places(places, documents, size):
    """``documents``: ids of each row, with the end. Each id lies in one part, each sequence is gapless, checksums and sizes hold. Returns the padding."""
    found = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for p in places:
        found[p.row].append(p)
        by_sequence[p.sequence_id].append(p)
    rows = collections.Counter()
    for parts in found.values():
        parts.sort(key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and p.length > 0
            at += p.length
        assert at == parts[0].doc_tokens
        rows[(parts[0].doc_id, at, tuple((p.start, p.length, p.ids_crc32) for p in parts))] += 1
    held = collections.defaultdict(list)
    for i, ids in documents:
        held[i].append(ids)
    for (i, n, parts), times in rows.items():
        fits = [ids for ids in held[i] if len(ids) == n and all(crc(ids[a : a + k]) == c for a, k, c in parts)]
        assert len(fits) >= times
    assert sum(rows.values()) == len(documents)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        want = at if at & (at - 1) == 0 else size
        assert at <= size and {p.sequence_length for p in parts} == {want}
        padding += want - at
    return padding


def ids_of(text, end=1):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(1, 16))
def test_patterns_place_every_piece_once(histogram, least_cut):
    packed = packing.patterns(histogram, 64, least_cut)
    ids = collections.Counter()
    for n, places in packed:
        assert sum(length for _, _, length in places) <= 64
        for piece, start, length in places:
            for x in range(start, start + length):
                ids[piece, x] += n
    assert ids == {(piece, x): n for piece, n in histogram.items() for x in range(piece)}
    # the table leads each piece to all of its parts, none to the place of another
    table = packing.slots(histogram, packed)
    taken, number = set(), 0
    for length in sorted(histogram):
        for _ in range(histogram[length]):
            slot = int(np.searchsorted(table["first"], number, side="right")) - 1
            at = 0
            for part in range(table["at"][slot], table["at"][slot] + table["n"][slot]):
                assert table["part_start"][part] == at
                at += table["part_length"][part]
                for x in range(table["part_length"][part]):
                    place = (int(table["sequence"][part]) + number - int(table["first"][slot]), int(table["offset"][part]) + x)
                    assert place not in taken
                    taken.add(place)
            assert at == length
            number += 1
    assert len(taken) == sum(k * n for k, n in histogram.items())


def test_shortest_pack_first():
    # 6 opens a pack, 5 another; 3 goes to the one with more space, 2 to the other, which then has more
    assert sorted(packing.patterns({6: 1, 5: 1, 3: 1, 2: 1}, 10, 10)) == [(1, ((5, 0, 5), (3, 0, 3))), (1, ((6, 0, 6), (2, 0, 2)))]
    # a thousand alike are one pattern
    assert packing.patterns({400: 1000, 200: 1000}, 1000, 64) == [(100, ((200, 0, 200),) * 5), (500, ((400, 0, 400), (400, 0, 400), (200, 0, 200)))]


def test_little_padding_without_short_pieces():
    histogram = {n: 40 for n in range(600, 680)}  # three fit, and nothing fills their space of 8 to 248
    for least in (64, 8):
        packed = packing.patterns(histogram, 2048, least)
        total = sum(n for n, _ in packed) * 2048
        used = sum(k * n for k, n in histogram.items())
        assert (total - used) / total < (0.04 if least == 64 else 0.005)


def test_pack(spark, docs, no_docs):
    want = [(i, ids_of(t)) for i, t, _ in ROWS]
    for size, least in ((64, 8), (64, 64), (2048, 64)):
        places, pieces = packing.pack(docs, PATH, size=size, least_cut=least)
        rows = places.collect()
        check_places(rows, want, size)
        made = {r.sequence_id: r for r in packing.sequences(places, pieces).collect()}
        by_row = collections.defaultdict(dict)
        for p in pieces.collect():
            by_row[p.row][p.start] = np.frombuffer(p.ids, "<u2").tolist()
        for p in rows:
            whole = [x for start in sorted(by_row[p.row]) for x in by_row[p.row][start]]
            assert made[p.sequence_id].input_ids[p.offset : p.offset + p.length] == whole[p.start : p.start + p.length]
            assert len(set(made[p.sequence_id].documents[p.offset : p.offset + p.length])) == 1
        assert all(len(r.input_ids) == len(r.documents) == next(p.sequence_length for p in rows if p.sequence_id == s) for s, r in made.items())
    places, pieces = packing.pack(no_docs, PATH)
    assert places.count() == 0 and packing.sequences(places, pieces).count() == 0


def test_pack_query(spark, sf_dir):
    documents = [(r.doc_id, ids_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    places, _ = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH)
    padding = check_places(places.collect(), documents, 2048)
    total = sum(len(ids) for _, ids in documents)
    assert padding < 0.02 * total
    got = queries.op11_packing(spark, sf_dir).collect()
    assert sum(r.length for r in got) == total and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_cuts_reach_the_checksums(spark):
    # lengths that leave space: two of three fit side by side, the third is cut
    rows = [(i, "word " * (1200 + i % 7)) for i in range(40)]
    places, _ = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH)
    found = places.collect()
    assert len(found) > 40
    padding = check_places(found, [(i, ids_of(t)) for i, t in rows], 2048)
    assert padding < 0.1 * sum(len(ids_of(t)) for _, t in rows)


# ---- hard negatives

AWKWARD = [
    (0, [0.5, 0.5], 1), (100, [0.5, 0.25], 1), (100, [0.5, 0.25], 1), (100, [0.25, 0.5], 2), (3, None, 1), (4, [0.5, None], 1), (5, [float("nan"), 0.1], 1),
    (6, [float("inf"), 0.1], 2), (None, [0.5, 0.5], 2), (8, [0.5, 0.5], None), (9, [0.5, 0.5], 2), (9, [0.5, 0.5], 2), (10, [0.0, 0.0], 2), (200, [0.0, 0.0], 1), (11, [-0.5, -0.5], 1),
    (12, [0.4, 0.4], 2), (13, [0.45, 0.5], 1), (300, [0.5, 0.5, 0.5], 2), (14, [0.5, 0.5, 0.4], 2), (15, [0.5, 0.5, 0.39], 1), (16, [], 1), (400, [-0.3, -0.1], 3), (17, [0.4, 0.0], 3),
]


def negatives_by_hand(rows, every=100, low=80, high=100, k=5, scale=256):
    v = []
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, tuple(math.floor(scale * float(np.float32(c))) for c in x), label))
    out = []
    for a in sorted({r for r in v if r[0] % every == 0}):
        scored = [(-sum(p * q for p, q in zip(a[1], c[1], strict=True)), c[0], c[2]) for c in v if len(c[1]) == len(a[1])]
        for s, p in sorted((s, i) for s, i, label in scored if label == a[2] and i != a[0])[:k]:
            fits = sorted((t, i) for t, i, label in scored if label != a[2] and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(a[0], p, n, i, -s, -t) for n, (t, i) in enumerate(fits, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_awkward_negatives(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    df = spark.createDataFrame([(i, x, l) for i, x, l in AWKWARD], schema)
    clash = df.selectExpr("*", "1 as id", "2 as dim", "3 as norm", "4 as rank")
    got = hard_negatives.hard_negatives(clash).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == negatives_by_hand(AWKWARD)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id = 9")).count() == 0  # no anchor


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_negatives_of_many_lengths(spark, spread):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        size = math.exp(rng.gauss(0, spread))
        rows.append((i, [size * rng.gauss(0, 0.2) for _ in range(6)], rng.choice([1, 1, 1, 2, 3])))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for bucket, at_once in ((64, 8192), (32, 4)):
        got = hard_negatives.hard_negatives(df, bucket=bucket, anchors_at_once=at_once).select(*COLUMNS).collect()
        assert sorted(map(tuple, got)) == negatives_by_hand(rows)


def test_buckets_are_pruned():
    """Of vectors of very different lengths an anchor is multiplied with few, and loses none that counts."""
    rng = np.random.default_rng(3)
    m = np.floor(rng.normal(size=(4000, 8)) * np.exp(rng.normal(size=(4000, 1)) * 1.5) * 256)
    m = m[np.argsort(-np.sqrt((m * m).sum(axis=1)), kind="stable")]
    ids, labels = np.arange(4000), np.arange(4000) % 2
    q = m[2000:2010]
    w = hard_negatives.Wanted(ids[2000:2010], labels[2000:2010], q, 5, True)
    for i in range(0, 4000, 100):
        w.visit(ids[i : i + 100], labels[i : i + 100], m[i : i + 100])
    assert w.multiplied < 0.5 * 10 * 4000
    for r, best in enumerate(w.best):
        s = (q[r] @ m.T).astype(int)
        fits = (labels == labels[2000 + r]) & (ids != 2000 + r)
        assert best == sorted(zip((-s[fits]).tolist(), ids[fits].tolist(), strict=True))[:5]


def test_negatives_query(spark, sf_dir):
    got = queries.op12_hard_negatives(spark, sf_dir).toPandas()
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op12_hard_negatives"]).df()
    key = list(COLUMNS)
    assert len(want) and sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))


# ---- whitening


def whitened_by_hand(x, components=32):
    """From whole numbers, in exact sums: deviations n * x - S, whitened values, explained shares."""
    x = np.array([[int(c) for c in r] for r in x], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = x * n - sums
    exact = deviation.T @ deviation  # n ** 3 times the covariance
    covariance = np.array([[float(c) for c in r] for r in exact]) / float(n) ** 3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return (deviation * deviation).sum(axis=1), (deviation.astype(float) / n) @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_moments_are_merged_exactly():
    rng = np.random.default_rng(1)
    m = np.floor(rng.normal(size=(5000, 7)) * 30) + 1_000_000
    whole = whitening.Moments.of(m, True)
    cuts = [0, 1, 2, 700, 4000, 5000]
    merged = whitening.reduce(lambda a, b: a.merged(b), [whitening.Moments.of(m[a:b], True) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert merged.n == 5000 and list(merged.sums) == list(whole.sums) == [int(s) for s in m.astype(np.int64).sum(axis=0)]
    exact = np.cov((m - 1_000_000).T, bias=True) * 5000
    assert np.allclose(merged.scatter, exact, rtol=1e-12, atol=1e-6) and np.allclose(whole.scatter, exact, rtol=1e-12, atol=1e-6)


def test_deviations_beyond_64_bits():
    m = np.array([[2.0**50, 1.0], [-(2.0**50), 5.0], [3.0, 7.0]])
    f = whitening.fit(whitening.Moments.of(m, True), 2)
    got = f.deviations(m)
    assert got.dtype == object and got.tolist() == [[3 * int(c) - int(s) for c, s in zip(r, f.sums, strict=True)] for r in m.tolist()]


def test_awkward_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], 1) for i in range(50)]
    rows += [(None, [0.1, 0.2, 0.3], 1), (7, [0.5, -0.5, 0.1], 2), (7, [0.5, -0.5, 0.1], 2), (60, None, 1), (61, [1.0, None, 2.0], 1), (62, [float("nan")] * 3, 1), (63, [float("-inf"), 0.0, 0.0], 1), (64, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int")
    got = whitening.whiten(df, components=2).toPandas()
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in x]) for i, x, _ in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    squares, white, explained = whitened_by_hand([x for _, x in kept], 2)
    assert len(got) == 2 * len(kept) and set(got.n) == {len(kept)} and (got.identity_error < 1e-9).all() and got.vec_id.isna().sum() == 2
    for k in (1, 2):
        mine = got[got.component == k]
        assert np.allclose(sorted(mine.explained), [explained[k - 1]] * len(kept), rtol=1e-9)
        pairs = lambda sign: sorted((int(s), round(sign * w, 7) + 0.0) for s, w in zip(squares, white[:, k - 1], strict=True))  # noqa: E731, B023
        found = sorted((int(d), round(w, 7) + 0.0) for d, w in zip(mine.deviation, mine.whitened, strict=True))
        assert any(np.allclose(found, pairs(s), atol=1e-6) for s in (1, -1))
    # rows without variance have no components; an empty table has no rows; two dimensions are two fits
    assert whitening.whiten(df.filter("vec_id = 7 and n = 2")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten_vectors(df.filter("vec_id = 60")).count() == 0
    two = spark.createDataFrame([(i, [float(i % 3), float(i % 5)][: 1 + i % 2]) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert sorted((r.component, r["count"]) for r in whitening.whiten(two).groupBy("component").count().collect()) == [(1, 30), (2, 15)]


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    squares, white, explained = whitened_by_hand([[math.floor(64 * c) + 1_000_000 for c in r.embedding] for r in rows])
    got = queries.op13_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(rows) and str(got.deviation.dtype) == "int64" and (got.identity_error < 1e-9).all()
    found = got.whitened.to_numpy().reshape(-1, 32)
    sign = np.sign((found * white).sum(axis=0))
    assert np.allclose(found, white * sign, atol=1e-7)
    assert got.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == [int(s) for s in squares]
    assert np.allclose(got.explained.to_numpy().reshape(-1, 32), explained, rtol=1e-9)


def test_whole_vectors_refuse_what_is_too_large():
    import pyarrow as pa

    with pytest.raises(ValueError):
        list(vectors.whole_vectors(pa.array([[1e30]], pa.list_(pa.float64())), 256))

"""BPE, token files, mixing, quality, language model, search and WARC against the library, brute force and round trips."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, files, huffman, lm, mixing, quality, queries, token_files, topk, warc

from .conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
BPE = bpe.Bpe(open(PATH).read())


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab e'sltdrv \n\t.,1é<|endoftext|> 　", max_size=60))
def test_bpe_is_the_librarys(text):
    ids = BPE.encode(text)
    assert ids.tolist() == reference_ids(text)
    assert BPE.decode(ids) == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(ids):
    assert BPE.decode(np.array(ids, np.int64)) == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_bpe_query(docs, no_docs):
    want = []
    for i, t, _ in ROWS:
        ids = reference_ids(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.token_digests(docs, PATH).collect()))) == sorted(map(str, want))
    full = bpe.encode_documents(docs, PATH, with_text=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded, r.round_trip) for r in full) == sorted((str(i), reference_ids(t), t or "", True) for i, t, _ in ROWS)
    assert bpe.token_digests(no_docs, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=200), st.integers(8, 20), st.integers(1, 50), st.integers(0, 300))
def test_huffman(counts, limit, block, n):
    counts = np.array(counts)
    if not counts.any():
        counts[0] = 1
    code = huffman.Code(huffman.code_lengths(counts, limit))
    used = np.nonzero(counts)[0]
    assert (code.lengths > 0).sum() == len(used) and code.longest <= limit
    assert (0.5 ** code.lengths[used].astype(float)).sum() <= 1
    ids = np.random.default_rng(n).choice(used, n)
    bits, offsets = code.encode(ids, block)
    assert (code.decode(bits, n, offsets, block) == ids).all()


def test_token_files(spark, docs, no_docs):
    listed = token_files.write_tokens(docs, PATH, tokens_per_file=100, block=64)
    assert listed.count() > 2
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for i, t, _ in order:
        ids = [*reference_ids(t), 0]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    got = token_files.read_tokens(listed).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in got), key=lambda r: r[1]) == want
    crc = {r.start: r.ids_crc32 for r in token_files.read_tokens(listed, digests=True).collect()}
    assert crc == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in want}
    path = max(listed.collect(), key=lambda r: r.tokens).path
    data = bytearray(files.read(path))
    _, sizes, ids = token_files.unpack_file(bytes(data))
    ends = np.cumsum(sizes)
    for k in range(len(sizes)):
        assert (token_files.document_ids(path, k) == ids[ends[k] - sizes[k] : ends[k]]).all()
    data[-10] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_file(bytes(data))
    assert token_files.read_tokens(token_files.write_tokens(no_docs, PATH)).count() == 0


def water(sizes, weights, most):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, target = set(names), sum(sizes.values()), {}
    while True:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] > most * sizes[s] * total} if total else set()
        if not above:
            return target | {s: left * w[s] / total for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above


def check_mix(rows, got):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    target = water(size, mixing.WEIGHTS, mixing.MOST)
    assert len(got) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_mixing(spark, docs, no_docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 400]), rng.choice(["a", "a", "a", "a", "b", "c", "é", "z", None])) for i in range(500)] + [(600, "w", "tiny"), (601, "", "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    check_mix(ROWS, mixing.mix(docs).collect())
    out = mixing.mixed_documents(df)
    copies = collections.Counter(r.doc_id for r in out.collect())
    assert out.columns == df.columns and all(copies[r.doc_id] == r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    # rows that repeat an id are drawn one by one
    twice = df.union(df.filter("doc_id < 100"))
    sizes = collections.Counter()
    for r in mixing.mixed_documents(twice).collect():
        sizes[r.source] += len(r.text.split())
    check = mixing.mix(twice).collect()
    assert sizes == {r.source: sum(x.taken for x in check if x.source == r.source) for r in check if any(x.copies for x in check if x.source == r.source)}
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(2)
    lines = np.array([3, 1, 5])
    x = rng.normal(size=(9, 4))
    chain = quality.Chain(rng.normal(size=4), 0.7)
    good, same = chain.marginals(x, lines)
    at = 0
    for n in lines:
        s, total = x[at : at + n] @ chain.unary, 0.0
        g, e = np.zeros(n), np.zeros(n)
        for k in range(2**n):
            y = (k >> np.arange(n)) & 1
            p = math.exp((s * y).sum() + 0.7 * (y[1:] == y[:-1]).sum())
            total += p
            g += p * y
            e[1:] += p * (y[1:] == y[:-1])
        assert np.allclose(good[at : at + n], g / total) and np.allclose(same[at + 1 : at + n], e[1:] / total)
        at += n


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op5_quality_crf(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    test = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 30 and all(r.held_out for r, _ in test)
    assert sum(r.predicted == q for r, q in test) / len(test) > 0.93


def test_quality_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (9, 0, 1), (14, 1, 0), (None, 0, 0), (7, None, 0), (7, 5, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.classify(no_docs, labels).count() == 0 and quality.good_documents(no_docs, labels).count() == 0


def test_features_do_not_depend_on_neighbouring_texts():
    texts = [(t or "").encode() for _, t, _ in ROWS]
    x, _, lines = quality.line_features(texts)
    at = 0
    for t, n in zip(texts, lines, strict=True):
        y, _, m = quality.line_features([t])
        assert m[0] == n and np.allclose(x[at : at + n], y)
        at += n


def test_long_texts_go_through_in_windows(monkeypatch):
    rng = random.Random(3)
    texts = ["\n".join("x" * rng.randint(0, 9) + " |" * rng.randint(0, 1) + " Aa. 1" * rng.randint(0, 4) for _ in range(n)).encode() for n in (700, 1, 40, 699, 3)] + [b"\n" * 900, b"", None]
    model = quality.Model(texts * 4, np.array([0, 1] * 16), steps=20)
    want = model.scores(texts)
    lines = [model.lines(t) for t in texts]
    monkeypatch.setattr(quality, "PART_LINES", 7)
    monkeypatch.setattr(quality, "PART_BYTES", 90)
    assert model.scores(texts) == pytest.approx(want, abs=1e-9)
    assert all(model.lines(t) == pytest.approx(x, abs=1e-9) for t, x in zip(texts, lines, strict=True))


def test_a_very_long_text_of_short_lines_takes_little_memory():
    model = quality.Model([b"a b\nc", b"| |\n|"] * 8, np.array([1, 0] * 8), steps=20)
    tracemalloc.start()
    assert 0 <= model.scores([b"ab\n" * 1_700_000])[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def brute_lm(rows, prior=lm.PRIOR):
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]) for i, t in rows]
    train = [w for i, w in toks if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = collections.Counter(tuple(w[k : k + size]) for w in train for size in (1, 2, 3) for k in range(len(w) - size + 1))
    n, v = sum(len(w) for w in train), sum(len(k) == 1 for k in c)
    least = lambda k: 2 ** math.floor(math.log2(c[k])) if c[k] else 0
    most = lambda k: 2 * least(k) - 1 if c[k] else 0
    out = []
    for i, w in toks:
        base = score = 0.0
        for k, x in enumerate(w):
            p = (c[x,] + 1) / (n + v + 1)
            base += math.log10(p)
            if k:
                p = (least((w[k - 1], x)) + prior * p) / (c[w[k - 1],] + prior)
            if k > 1:
                p = (least((w[k - 2], w[k - 1], x)) + prior * p) / (most((w[k - 2], w[k - 1])) + prior)
            score += math.log10(p)
        out.append((i, len(w), sum(c[x,] > 0 for x in w), n, base, score))
    return out


def same_scores(got, want):
    """All but the score is exact; the filter's false positives move that little."""
    cols = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted(([str(r.doc_id), *(r[c] for c in cols[1:])] for r in got), key=lambda r: r[:2] + r[4:5])
    want = sorted(([str(r[0]), *r[1:]] for r in want), key=lambda r: r[:2] + r[4:5])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])
    assert sum(r[5] for r in got) == pytest.approx(sum(r[5] for r in want), rel=0.01)
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=0.05)
    return [r[5] for r in got]


def test_language_model(spark, docs, no_docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 80)))) for i in range(150)] + [(200, None), (201, "W1 w1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_lm(rows)
    same_scores(lm.train_and_score(df).collect(), want)
    # the same result, from the same segments, where no worker may hold the model
    many = same_scores(lm.train_and_score(df, shard_entries=100).collect(), want)
    assert same_scores(lm.train_and_score(df, shard_entries=100, broadcast_bytes=0).collect(), want) == pytest.approx(many, rel=1e-12)
    for options in ({}, {"broadcast_bytes": 0}):
        same_scores(lm.train_and_score(docs, **options).collect(), brute_lm([r[:2] for r in ROWS]))
        assert lm.train_and_score(no_docs, **options).count() == 0


def test_a_language_model_that_no_worker_holds_moves_runs_once(spark):
    """What is stored for it in the shared folder is less than the texts."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(3000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = stored()
    got = lm.train_and_score(df).collect()
    assert len(got) == 100 and stored() - before < sum(len(t) for _, t in rows)
    sent = same_scores(lm.train_and_score(df, broadcast_bytes=1 << 29).collect(), brute_lm(rows))
    assert same_scores(got, brute_lm(rows)) == pytest.approx(sent, rel=1e-12)
    # what is dealt takes less than five bytes for each distinct run, beside the words
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows], "learned": [i % 7 > 0 for i, _ in rows]})
    out = pa.Table.from_batches(lm._dealt(32)(iter([batch])))
    runs = {tuple(w[k : k + n]) for _, t in rows for w in [[*t.split(), None]] for n in (2, 3) for k in range(len(w) - n + 1)}
    assert sum(len(x) for c in ("runs", "run_n") for x in out.column(c).to_pylist()) < 5 * len(runs)


def test_language_model_of_rows_that_come_in_another_order_when_read_again(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(20))) for i in range(60)] + [(7, None), (None, "w1 w2")]

    def dealt(batches):
        for b in batches:
            yield b.append_column("to", pa.array([random.SystemRandom().randrange(1000) for _ in range(b.num_rows)], pa.int64()))

    df = spark.createDataFrame(rows, "doc_id bigint, text string").mapInArrow(dealt, "doc_id bigint, text string, to bigint").repartition(3, "to").drop("to")
    same_scores(lm.train_and_score(df).collect(), brute_lm(rows))


def test_numbers_and_sorted_hashes_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        for low, high in ((4, 256), (6, 1), (6, 2049)):
            v = np.sort(rng.integers(0, high << 8 * low, n, dtype=np.uint64))
            assert (lm._unsqueezed(memoryview(lm._squeezed(v, low, high)), low, high) == v).all()
        for widths in (lm.DEALT_BITS, lm.COUNT_BITS, lm.LEVEL_BITS):
            x = np.minimum(rng.integers(0, 2**rng.integers(1, 62, n)), 255 if widths[-1] == 8 else 1 << 62)
            assert (lm._unsmall(memoryview(lm._small(x, *widths)), n, *widths) == x).all()


def test_language_model_of_a_word_that_follows_every_other(spark):
    rows = [(i, " ".join(f"x{k} the" for k in range(i * 5000, i * 5000 + 5000))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    sizes = [r["size"] for r in lm.train(df, shard_entries=50_000).collect()]
    assert len(sizes) > 32 and max(sizes) < 1.3 * min(sizes)


def test_log_frequency_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2)
    counts = rng.integers(1, 2000, 20000)
    bits, entries = lm.build_filter(h & np.uint64((1 << 8 * lm.RUN_BYTES) - 1), counts)
    model = lm.Model(np.empty(0, np.uint64), np.empty(0, np.int64), bits, np.array([len(bits)]), 1)
    got, exact = model.level(h), lm.levels(counts)
    assert (got >= exact).all() and (got == exact).mean() > 0.97
    assert (lm.least_count(exact) <= counts).all() and (counts <= lm.greatest_count(exact)).all()
    assert (model.level(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)) > 0).mean() < 0.03


def brute_topk(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    out = []
    for i, q in ok:
        if i % every == 0:
            got = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(got)]
    return sorted(set(out))


def test_top_k(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        scale = 10 ** rng.uniform(-1, 1)
        rows.append((i, [float(np.float32(scale * rng.choice([rng.gauss(0, 1), 0.5, -0.25]))) for _ in range(6)]))
    rows += [(500, None), (501, []), (502, [float("nan")] + [0.0] * 5), (503, [None] + [0.0] * 5), (504, [0.0] * 6), (510, [1.0, 2.0]), (520, [3.0, 1.0]), (None, [1.0] * 6), (530, [float("inf")] * 6)]
    rows += [(600 + i, rows[7][1]) for i in range(15)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    for every, bucket in ((10, 2048), (10, 32), (1, 50)):
        got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=every, bucket=bucket, queries_at_once=150).collect())
        assert got == brute_topk(rows, 5, every)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id in (1, 2, 510)"), every=10).count() == 0


def test_coordinate_pruning_is_used_and_exact():
    rng = np.random.default_rng(3)
    m = np.floor(1024 * rng.normal(size=(3000, 8)))
    m = m[np.argsort(-np.sqrt((m * m).sum(axis=1)), kind="stable")]
    ids = np.arange(len(m)) + 1000
    q = m[rng.choice(len(m), 40)] + 3
    s = topk.Search(np.arange(40), q, 10)
    s.floor(ids[:2048], m[:2048])
    for a in range(0, len(m), 500):
        s.visit(ids[a : a + 500], m[a : a + 500])
    for i in range(40):
        scores = (m @ q[i]).astype(np.int64)
        assert s.best[i] == sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:10]


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é中\r\n\r\n😀"), (None, "http://e/", "<p>x</p>"), (None, "u", "only"), (9, "http://f/", "WARC/1.1\r\n\r\n" * 50), (2, "http://b/", "<p>x</p>"), (10, "http://g/", "z" * 300000)]


def test_warc(spark):
    df = spark.createDataFrame([(*p, "r", 1) for p in PAGES], "page_id bigint, url string, html string, record_type string, payload int")
    listed = warc.write_warc(df, frame_bytes=500, bundle_bytes=2000)
    got = warc.read_warc(listed)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        top = max((j for j, _, g in PAGES if j is not None and (g or "") == (h or "")), default=None)
        want.append((i, len(raw), warc.digest(raw), "response" if i == top else "revisit", None if i == top else top))
    rows = got.collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == sorted(map(str, want))
    assert {r.html for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    some = warc.read_warc(listed, {5, None}).collect()
    assert sorted(map(str, some)) == sorted(str(r) for r in rows if r.page_id in (5, None)) and len(some) > 2
    readers = [warc.opened(r.path) for r in listed.collect()]
    assert sum(len(r.index()) for r in readers) == len(PAGES) and len({i for r in readers for i in r.index()}) == len(PAGES)
    for r in readers:
        for identifier in r.index():
            assert r.record(identifier)[0]["WARC-Record-ID"] == identifier
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0
    index = warc.record_index(listed)
    assert index.count() == len(PAGES) == index.select("record_id").distinct().count()
    found = warc.fetch(index.filter("page_id = 2 or page_id = 9"))
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in rows if r.page_id in (2, 9)) and warc.fetch(index.limit(0)).count() == 0
    all_responses = warc.read_warc(warc.write_warc(df, least_bytes=9)).filter("payload_bytes < 9")
    assert {r.record_type for r in all_responses.collect()} == {"response"}


def test_records_of_repeated_rows_have_identifiers_of_their_own(spark):
    rows = [(7, "u", "same")] * 5000 + [(7, "v", "same")] * 3 + [(7, None, "same"), (7, "", "same"), (3, "u", "same"), (None, "u", "same"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8)
    listed = warc.write_warc(df, bundle_bytes=200_000)
    index = warc.record_index(listed)
    assert listed.count() > 2 and index.count() == len(rows) == index.select("record_id").distinct().count()
    assert index.filter(index.record_id == warc.record_id(7, warc.digest(b"same"))).count() == 1
    got = collections.Counter((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_warc(listed).collect())
    assert got == {(7, "u", "response", None): 5000, (7, "v", "response", None): 3, (7, "", "response", None): 2, (3, "u", "revisit", 7): 1, (None, "u", "revisit", 7): 2}
    again = warc.record_index(warc.write_warc(df.repartition(3)))
    assert index.select("record_id").exceptAll(again.select("record_id")).count() == 0


def test_bundle_is_a_plain_zstandard_file_too():
    import io

    import zstandard

    b = warc.Bundle(frame_bytes=100)
    records = [warc.make_record(i, f"http://{i}/", b"x" * i, None) for i in range(20)]
    for i in range(20):
        b.add(i, f"http://{i}/", b"x" * i, None)
    b.add(3, "http://3/", b"xxx", None, "again")
    data = b.close()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.startswith(b"".join(r for _, r in records))
    reader = warc.Reader(lambda s, n: data[s : s + n], len(data))
    assert reader.record(records[13][0])[2] == b"x" * 13 and reader.record("<urn:uuid:0>") is None
    assert len(reader.index()) == 21 and [r[2] for r in reader.records({3})] == [b"xxx"] * 2

"""Exact and near duplicates, repeated passages and components against brute force."""

import hashlib
import random
import re

import public_tokenizers

from textloom.llm import exact_dedup, near_dedup, substring_dedup
from textloom.llm.components import components

from .conftest import ROWS

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_exact(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t, _ in ROWS:
        norm = SPACE.sub("", t or "")
        keep = min(groups[norm])[2]
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_by_smallest_id_and_documents(docs, no_docs):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs, longest=False).collect()}
    assert got[11] == 1 and got[2] == 1 and got[6] == 4
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 in ids and 1 not in ids and 11 not in ids and ids.count(7) == 1
    texts = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub("", t or "") for _, t, _ in ROWS})
    # a repeated row, an id with two texts, ids that are all null
    odd = docs.sparkSession.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "z z"), (None, "n"), (None, "n "), (None, "m")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.distinct_documents(odd).collect()) == [("1", "x"), ("1", "y"), ("2", "z z"), ("None", "m"), ("None", "n ")]
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.distinct_documents(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    for nodes, edges in ((200, 150), (400, 380)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 80)]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        want = {x: root(x) for p in pairs if p[0] != p[1] for x in p}
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
        assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u bigint, v bigint")).count() == 0


def brute_near(rows, k, t):
    def shingles(text):
        w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= t * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def noisy_group(rng, size, words, first_id):
    """Copies of one text with more or fewer changed words: hubs, members linked by a hub alone, and some linked with none."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first_id + i, " ".join(w)))
    return out


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    rows = noisy_group(rng, 70, 120, 100) + noisy_group(rng, 25, 60, 300) + [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    rows += [(900, "A b C"), (901, "a B c"), (902, "a b"), (903, "A B"), (904, ""), (905, None), (906, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, t, bands, r in ((3, 85, 30, 6), (5, 80, 32, 5)):
        for block in (256, 16):  # with small blocks a bucket is cut and its blocks meet in pairs
            got = {tuple(x) for x in near_dedup.near_dedup(df, shingle=k, numerator=t, bands=bands, rows=r, block=block).collect()}
            assert got == brute_near(rows, k, t)


def test_near_links_whose_sketches_err(spark):
    """Pairs right at the threshold whose two-bit estimates are 3 to 4 deviations too low."""
    op3 = (254, 343, 771, 1057, 1159, 1360, 1893, 2355, 2749, 2754, 2925, 3209, 3212, 3340, 3420, 3523, 3865)
    pipeline = (507, 1241, 1337, 1359, 1528, 1897, 2068, 2410, 2813, 3418, 3426, 3553, 3654)
    for k, t, bands, r, seeds, n in ((3, 85, 30, 6, op3, 39), (5, 80, 32, 5, pipeline, 40)):
        rows = []
        for seed in seeds:
            rng = random.Random(seed)
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(2 * seed, " ".join(w)), (2 * seed + 1, " ".join(w[:36] + [f"x{rng.randrange(10**6)}" for _ in range(n - 36)]))]
        got = {tuple(x) for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=k, numerator=t, bands=bands, rows=r).collect()}
        assert got == brute_near(rows, k, t) and {x[2] for x in got} == {2 * s for s in seeds}


def test_near_awkward_rows(docs, no_docs):
    got = near_dedup.near_dedup(docs, shingle=3, numerator=85, bands=30, rows=6)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by[i].component_id for i in (1, 2, 3, 11)} == {1} and by[5].n_shingles == 0 and by[10].n_shingles == 1 and by[15].component_id == 14
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    kept = near_dedup.without_near_duplicates(docs, shingle=3, numerator=85, bands=30, rows=6)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 7, 8, 9, 10, 14]
    assert near_dedup.near_dedup(no_docs).count() == 0


def brute_passages(rows, least=51, within=False):
    """Runs of words, byte for byte, that a smaller id has too, or with ``within`` the row itself without overlap; no chunks, anchors or hashes. Rows are known by their number."""
    windows, first = [], {}
    for row, (i, t) in enumerate(dict.fromkeys(rows)):
        raw = (t or "").encode()
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for n in range(len(at) - least + 1):
            key = raw[at[n][0] : at[n + least - 1][1]]
            first[key] = min(first.get(key, i), i)
            windows.append((row, i, n, at[n][0], at[n + least - 1][1], key))
    out, own = [], {}
    for row, i, n, a, b, key in windows:
        before = own.setdefault((row, key), n)
        if first[key] == i and not (within and n - before >= least):
            continue
        if out and out[-1][0] == row and n - out[-1][2] < least:
            out[-1][2], out[-1][4], out[-1][5] = n, b, out[-1][5] + n - out[-1][2]
        else:
            out.append([row, i, n, a, b, least, first[key]])
    return {(i, a, b, words, f) for _, i, _, a, b, words, f in out}


def test_passages_of_short_words_against_brute_force(spark):
    rng = random.Random(12)

    def text(n, low, high):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high))) for _ in range(n))

    rows, planted = [], set()
    for k, (n, low, high) in enumerate([(51, 1, 1), (51, 1, 2), (51, 2, 4), (51, 1, 6), (51, 3, 9), (50, 2, 4), (60, 2, 4)] * 12):
        passage = text(n, low, high)
        rows += [(100 * k + j, f"{text(rng.randint(0, 80), low, high)} {passage}\n{text(rng.randint(0, 80), low, high)}") for j in range(1, 4)]
        planted |= {100 * k + 2, 100 * k + 3} if n > 50 else set()
    # parts of a passage come earlier than the whole of it
    whole = text(51, 2, 4)
    rows += [(20000, whole[:-8] + " other"), (20001, "other " + whole[8:]), (20002, f"{text(9, 2, 4)} {whole}"), (20003, f"{whole} {text(9, 2, 4)}")]
    rows += [(20010, "ab " * 300), (20011, "ab " * 200), (20012, f"{text(30, 1, 9)}é" * 3), (20013, None), (20014, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in substring_dedup.repeated_passages(df).collect()]
    assert set(got) == brute_passages(rows) and len(got) == len(set(got))
    assert {r[0] for r in got} == planted | {20003, 20011}


def test_passages_of_rows_that_repeat_an_id(docs, no_docs):
    got = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(15, 14)} and len(got) == 1
    few = {(r.doc_id, r.first_doc_id, r.words) for r in substring_dedup.repeated_passages(docs, 9).collect() if r.doc_id != 15}
    assert few == {(11, 1, 9)}
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_passages_of_different_texts_of_one_id(spark):
    """Each row is judged by itself: what one text of an id repeats is not taken from another."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    one, two, own, tail = text(60), text(60), text(20), text(25)
    rows = [(1, f"{one} {text(10)}"), (2, two), (3, f"{own} {one}"), (3, f"{two} {tail}"), (3, two), (3, f"{own} {one}"), (4, f"{text(70)} {own} {text(60)}"), (4, two)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (51, 15):
        got = [tuple(r) for r in substring_dedup.repeated_passages(df, least).collect()]
        assert set(got) == brute_passages(rows, least)
    left = sorted((r.doc_id, r.text.strip()) for r in substring_dedup.without_repeats(df).collect())
    assert left == sorted([(1, rows[0][1]), (2, two), (3, own), (3, tail), (3, ""), (3, own), (4, rows[6][1]), (4, "")])


def test_passages_that_one_document_repeats(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, other = text(60), text(80)
    rows = [(1, f"{passage} {text(30)} {passage}"), (2, f"{text(20)} {other}\n{text(9)} {other} {passage}"), (3, " ".join([passage] * 5)), (4, text(300)), (5, "ab " * 400), (6, f"{text(60)} {rng.choice('xyz')}"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (51, 20):
        got = [tuple(r) for r in substring_dedup.repeated_passages(df, least, within=True).collect()]
        assert sorted(got) == sorted(brute_passages(rows, least, True))
    assert {r[0] for r in got} >= {1, 2, 3, 5} and {r[0] for r in brute_passages(rows)} == {2, 3}
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(df, within=True).collect()}
    assert left[1].count(passage) == 1 and left[2].count(other) == 1 and passage not in left[2] and left[4] == rows[3][1]


def test_passages_of_copies_and_of_other_lengths(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randint(5, 400))) for i in range(30)]
    rows += [(40 + i, f"{text(20 + i)} {passage} {text(40)}") for i in range(6)]
    rows += [(60, f"{text(60)}\n" * 3), (61, None), (62, ""), (63, rows[3][1]), (64, "aaaa " * 4000), (65, rows[30][1]), (66, rows[31][1]), (67, f" {rows[31][1]}\n"), (39, rows[31][1])]
    # one word, one letter and one line over and over; a text that begins as an earlier one does and has a copy
    rows += [(70, "aaaa " * 3000), (71, "a" * 9000), (72, f"{rows[33][1]} {text(30)}"), (74, f"{rows[33][1]} and more"), (75, f"{rows[33][1]} and more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (51, 52, 20, 7, 3, 2):
        got = [tuple(r) for r in substring_dedup.repeated_passages(df, least).collect()]
        assert sorted(got) == sorted(brute_passages(rows, least)), least
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    assert cut[39] == rows[31][1] and passage not in cut[40] and len(cut[42]) < len(rows[32][1]) - 200 and cut[61] is None and len(cut) == len(rows)


def test_passages_awkward_rows(docs, no_docs):
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and substring_dedup.without_repeats(no_docs).count() == 0


def test_cuts_come_back_after_an_insertion():
    rng = random.Random(1)
    raw = "".join(rng.choice("abcdefgh  ") for _ in range(4000)).encode()
    a, b = (substring_dedup.Cut([x], 51).cuts.tolist() for x in (raw, raw[:500] + b"inserted" + raw[500:]))
    assert {x for x in a if x > 1000} == {x - 8 for x in b if x > 1008} and {x for x in a if x < 200} == {x for x in b if x < 200}


def test_copy_stages_of_the_pipeline(spark, docs, no_docs):
    """The stages exact and near with the pipeline's own parameters, one after the other."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mix", "bpe"]
    rng = random.Random(21)
    near = noisy_group(rng, 30, 60, 100)
    rows = [(i, t) for i, t, _ in ROWS if i not in (None, 7)] + near + [(200 + i, f" {t}\n") for i, t in near[:5]]
    distinct = {}
    for i, t in rows:
        distinct.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    kept = {min(g)[1] for g in distinct.values()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'s' AS source")
    exact = stages["exact"](spark, df, "")
    assert exact.columns == df.columns and sorted(r.doc_id for r in exact.collect()) == sorted(kept)
    left = stages["near"](spark, exact, "")
    want = [i for i, _, _, first in brute_near([r for r in rows if r[0] in kept], 5, 80) if first]
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(want)
    for name in ("exact", "near"):
        assert stages[name](spark, docs, "").columns == docs.columns and stages[name](spark, no_docs, "").count() == 0


def test_whole_pipeline_on_awkward_rows(spark, tmp_path, monkeypatch):
    """run() against its stages one by one, each against brute force on what its predecessor kept; with nulls, repeated ids and clashing columns, and on an empty table."""
    import corpus_pipeline
    from textloom.llm import mixing, quality
    from tokenizers import Tokenizer

    rng = random.Random(33)
    near = noisy_group(rng, 25, 60, 300)
    good = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(40))) for i in range(400, 440)]
    rows = [(i, t, rng.choice(["a", "b", None]), "x", 1, 2.0) for i, t in [r[:2] for r in ROWS] + near + good + good[:5] + [(None, good[7][1])]]
    schema = "doc_id bigint, text string, source string, quality_score string, row_number int, copies double"
    for name, table in (("full", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(table, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(i, int(i < 436)) for i, _ in good], "doc_id bigint, quality int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

    sf, docs = str(tmp_path / "full"), spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    stages, count = dict(corpus_pipeline.STAGES), lambda df: sorted(map(str, df.collect()))
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = stages["quality"](spark, docs, sf)
    assert left.columns == docs.columns
    assert count(left) == sorted(str(r) for r in docs.collect() if model.scores([r.text.encode() if r.text else None])[0] >= 0.3)
    assert left.count() > 40
    groups = {}
    for r in left.collect():
        groups.setdefault(SPACE.sub("", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, (str(r.doc_id), r.text or "")))
    rows_before = count(left)
    left = stages["exact"](spark, left, sf)
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted(min(g)[3] for g in groups.values())
    assert set(count(left)) <= set(rows_before) and left.columns == docs.columns
    kept = {i for i, _, _, first in brute_near([(r.doc_id, r.text) for r in left.collect() if r.doc_id is not None], 5, 80) if first}
    before = left.collect()
    left = stages["near"](spark, left, sf)
    assert count(left) == sorted(str(r) for r in before if r.doc_id is None or r.doc_id in kept)
    mixed = stages["mix"](spark, left, sf)
    words = lambda df: sum(len((r.text or "").encode().split()) for r in df.collect())
    assert words(mixed) == sum(r.taken for r in mixing.mix(left).collect()) and set(count(mixed)) <= set(count(left)) and mixed.columns == docs.columns
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r.doc_id), tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in mixed.collect())

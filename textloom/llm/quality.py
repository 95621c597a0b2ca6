"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts of byte classes and words of the line itself, of the line before and of the line
after. The chain's weights are learnt from whole documents with known labels (all lines of a document carry its label); for a
text, forward-backward gives each line's marginal chance to be good. A document's quality is the mean of these, weighted by the
lines' lengths, and a logistic curve, fitted on labelled documents that the chain did not see, turns it into a probability.

Features look at the text alone. They are computed for a batch of texts at once in numpy; whole texts, whatever their length. A long text goes
through in windows of lines, of which only the evidence of each line is kept; the chain's messages then run over all lines.

Training takes a bounded sample: of the ``sample`` labelled ids with the least hash one text each, as many as ``sample_bytes`` hold; longer texts than
``sample_text`` are passed over. That is all that the driver ever holds.

Defined results: null and empty texts are one empty line and get a score as any other. Without labels of both kinds each document
gets the share of good labels (1 without labels). Labels that are null or neither 0 nor 1, and null ids, aren't learnt from. Rows keep their
multiplicity. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import binary, fresh, map_batches
from textloom.session import ship

SAMPLE = 6000
THRESHOLD = 0.3
FOLDS = 5
#: Bounds of the sample: bytes in all, and of one text.
SAMPLE_BYTES, SAMPLE_TEXT = 64_000_000, 1_000_000
#: What is made into features at once.
PART_BYTES, PART_LINES = 500_000, 20_000

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _MARK, _HIGH = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _STOP
_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int32 if len(values) < 1 << 31 else np.int64)])
    return total[starts + sizes] - total[starts]


def _distinct(owner: np.ndarray, hashes: np.ndarray, owners: int) -> np.ndarray:
    """How many distinct hashes each owner has."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(36)).astype(np.int64), minlength=owners)


def _word_hashes(data: np.ndarray, begins: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word, a megabyte of words at a time."""
    ends, out, i = np.cumsum(length), np.empty(len(begins), np.uint64), 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000)))
        size = length[i:j]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        out[i:j] = np.add.reduceat(_BYTE[data[np.repeat(begins[i:j], size) + place]] * _PLACE[place & 63], first)
        i = j
    return out


#: The column of a line's own features that looks at its whole text: the share of distinct lines.
_UNLIKE = 18


def _own(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: their own features but for _UNLIKE, their sizes, their hashes; the number of lines of each text."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    ends = np.nonzero(data == 10)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    lines = np.array([(t or b"").count(b"\n") + 1 for t in texts])
    n = len(starts)
    kind = _CLASS[data]
    by = {k: _sums(kind == k, starts, sizes).astype(float) for k in range(7)}
    inside = kind != _SPACE
    begins = np.nonzero(inside & ~np.concatenate([[False], inside[:-1]]))[0]
    lasts = np.nonzero(inside & ~np.concatenate([inside[1:], [False]]))[0]
    of = np.searchsorted(ends, begins)
    words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = lasts - begins + 1
    hashes = _word_hashes(data, begins, length)
    again = np.zeros(len(begins), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    size = np.maximum(sizes, 1).astype(float)
    letters = np.maximum(by[_UPPER] + by[_LOWER], 1)
    final = np.where(sizes > 0, kind[np.maximum(ends - 1, 0)], _SPACE)
    marked = np.bincount(of, weights=kind[lasts] == _MARK, minlength=n) / some
    spread = _distinct(of, hashes, n) / some
    repeats = np.bincount(of, weights=again, minlength=n) / some
    upper = by[_UPPER] / letters
    own = np.stack([
        np.log1p(sizes) / 8, np.log1p(words) / 6, upper, upper**2, by[_DIGIT] / size, by[_MARK] / size, by[_STOP] / some, by[_HIGH] / size,
        marked, marked**2, np.bincount(of, weights=data[begins] == ord("|"), minlength=n) / some, np.minimum(np.bincount(of, weights=length, minlength=n) / some / 10, 3),
        spread * (words > 0), spread**2 * (words > 0), repeats, np.sqrt(repeats), (final == _STOP).astype(float), (sizes == 0).astype(float), np.zeros(n),
        (words > 20) * (1 - spread), (data[np.minimum(starts, len(data) - 1)] == 32).astype(float),
    ], axis=1)
    return own, sizes, _sums_u64(hashes, of, n), lines


def _beside(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of lines: their own and those of the lines before and after, where ``first`` marks the first line of each text."""
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[np.roll(first, -1)] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1)), first[:, None]], axis=1)


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts; each line's weight (its length); the number of lines of each text."""
    own, sizes, hashes, lines = _own(texts)
    own[:, _UNLIKE] = np.repeat(_distinct(np.repeat(np.arange(len(texts)), lines), hashes, len(texts)) / lines, lines)
    first = np.zeros(len(own), bool)
    first[np.cumsum(lines) - lines] = True
    return _beside(own, first), sizes + 1.0, lines


def windowed_evidence(text: bytes, evidence) -> tuple[np.ndarray, np.ndarray]:
    """What ``evidence`` makes of the features of each line of a long text, and the lines' weights, a window of lines at a time."""
    ends = np.append(np.nonzero(np.frombuffer(text, np.uint8) == 10)[0], len(text))
    starts, n, windows, i = np.append(0, ends[:-1] + 1), len(ends), [], 0
    while i < n:
        j = min(n, i + PART_LINES, max(i + 1, int(np.searchsorted(ends, starts[i] + PART_BYTES))))
        windows.append((i, j))
        i = j
    hashes = np.concatenate([_own([text[starts[i] : ends[j - 1]]])[2] for i, j in windows])
    unlike = _distinct(np.zeros(n, np.int64), hashes, 1)[0] / n
    out = np.empty(n)
    for i, j in windows:
        a, b = max(i - 1, 0), min(j + 1, n)  # with a line on either side, for the neighbours' features
        own = _own([text[starts[a] : ends[b - 1]]])[0]
        own[:, _UNLIKE] = unlike
        first = np.zeros(b - a, bool)
        first[0] = True
        out[i:j] = evidence(_beside(own, first)[i - a : j - a])
    return out, ends - starts + 1.0


def is_long(text: bytes | None) -> bool:
    return text is not None and (len(text) > PART_BYTES or text.count(b"\n") >= PART_LINES)


def in_parts(texts: list[bytes | None]):
    """Runs of texts of about PART_BYTES and PART_LINES at most, so that the arrays made from them stay small; a long text is a run of its own."""
    part, size, lines = [], 0, 0
    for t in texts:
        n, m = len(t or b""), (t or b"").count(b"\n") + 1
        if part and (size + n > PART_BYTES or lines + m > PART_LINES):
            yield part
            part, size, lines = [], 0, 0
        part.append(t)
        size, lines = size + n, lines + m
    if part:
        yield part


def all_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of many texts, part by part."""
    parts = [line_features(p) for p in in_parts(texts)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sums_u64(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """One hash for each line, from its words in their order."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * (np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(of, of).astype(np.uint64) + np.uint64(3))
    out = np.zeros(n, np.uint64)
    if len(of):
        runs = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
        out[of[runs]] = np.add.reduceat(mixed, runs)
    return out * np.uint64(0x9E3779B97F4A7C15)


class Chain:
    """Two labels; ``unary``: the evidence for good of each feature; ``stay``: the reward for neighbours of the same label."""

    def __init__(self, unary: np.ndarray, stay: float):
        self.unary, self.stay = unary, stay

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of good for each line, and of equal labels for each line and the one before it (0 for a first line)."""
        return self.marginals_of(x @ self.unary, lines)

    def _run(self, sent: np.ndarray, s: np.ndarray, places: range) -> None:
        """Messages along one text, from place to place, as plain numbers."""
        stay, exp, log1p, step = self.stay, math.exp, math.log1p, places.step
        for k in range(0, len(places), 1 << 16):
            some = places[k : k + (1 << 16)]
            came = slice(min(some[0], some[-1]) - step if step > 0 else some[-1] + 1, max(some[0], some[-1]) if step > 0 else some[0] + 2)
            weight, m, out = s[came][::step].tolist(), float(sent[some[0] - step]), []
            for w in weight:
                m += w
                a, b = m + stay, m - stay
                m = (a if a > 0 else 0.0) + log1p(exp(-abs(a))) - (m if b > 0 else stay) - log1p(exp(-abs(b)))
                out.append(m)
            sent[min(some[0], some[-1]) : max(some[0], some[-1]) + 1] = out[::step]

    def marginals_of(self, s: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the lines' evidence for good."""
        start = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        start, count = start[order], lines[order]
        # log odds messages; all texts advance together, those that have ended drop out at the end of the order, and the last one goes on alone
        longest = int(count[0]) if len(count) else 0
        together = min(longest, int(count[1]) if len(count) > 1 else 1)
        active = np.searchsorted(-count, -np.arange(1, together + 1), side="right")
        forward, backward = np.zeros(len(s)), np.zeros(len(s))

        def passed(m):
            return np.logaddexp(m + self.stay, 0) - np.logaddexp(m, self.stay)

        for t in range(1, together):
            i = start[: active[t]] + t
            forward[i] = passed(forward[i - 1] + s[i - 1])
        if longest > together:
            a = int(start[0])
            self._run(forward, s, range(a + together, a + longest))
            self._run(backward, s, range(a + longest - 2, a + together - 2, -1))
        for t in range(together - 2, -1, -1):
            i = start[: active[t + 1]] + t
            backward[i] = passed(backward[i + 1] + s[i + 1])
        good = 1 / (1 + np.exp(-np.clip(forward + s + backward, -40, 40)))
        same = np.zeros(len(s))
        later = np.ones(len(s), bool)
        later[np.cumsum(lines) - lines] = False
        i = np.nonzero(later)[0]
        a, b = forward[i - 1] + s[i - 1], s[i] + backward[i]
        equal = np.logaddexp(a + b, 0) + self.stay
        same[i] = 1 / (1 + np.exp(np.clip(np.logaddexp(a, b) - equal, -40, 40)))
        return good, same

    def quality_of(self, s: np.ndarray, weights: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The share of good in each text, weighted, from the lines' evidence."""
        good, _ = self.marginals_of(s, lines)
        start = np.cumsum(lines) - lines
        return np.add.reduceat(good * weights, start) / np.add.reduceat(weights, start)


def _adam(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


class Model:
    """A chain, the features' means and deviations, and the logistic curve after it."""

    def __init__(self, texts: list[bytes | None], labels: np.ndarray, steps: int = 250, penalty: float = 1e-3):
        labels = np.asarray(labels, float)
        self.constant = None if 0 < labels.sum() < len(labels) else float(labels.mean()) if len(labels) else 1.0
        if self.constant is not None:
            return
        fit = np.arange(len(labels)) % 4 != 3
        if not 0 < labels[fit].sum() < fit.sum():
            fit[:] = True
        x, _, lines = all_features([t for t, f in zip(texts, fit, strict=True) if f])
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.mean[-2:], self.dev[-2:] = 0, 1
        x = (x - self.mean) / self.dev
        y, docs = np.repeat(labels[fit], lines), fit.sum()
        start = np.zeros(len(x), bool)
        start[np.cumsum(lines) - lines] = True

        def gradient(w):
            chain = Chain(w[:-1], w[-1])
            good, same = chain.marginals(x, lines)
            return np.concatenate([x.T @ (good - y), [(same - 1)[~start].sum()]]) / docs + penalty * w

        w = _adam(gradient, np.zeros(x.shape[1] + 1), steps, 0.05)
        self.chain = Chain(w[:-1], float(w[-1]))
        held = ~fit if 0 < labels[~fit].sum() < (~fit).sum() else fit
        self.curve = np.array([1.0, 0.0])
        q, y = self._logit([t for t, h in zip(texts, held, strict=True) if h]), labels[held]
        d = np.stack([q, np.ones(len(q))], axis=1)
        self.curve = _adam(lambda c: d.T @ (1 / (1 + np.exp(-d @ c)) - y) / len(y) + 1e-4 * c, self.curve, 600, 0.02)

    def _evidence(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.dev) @ self.chain.unary

    def _lines(self, part: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence and weights of the lines of some texts, as in_parts gives them, and how many lines each has."""
        if is_long(part[0]):
            s, weights = windowed_evidence(part[0], self._evidence)
            return s, weights, np.array([len(s)])
        x, weights, lines = line_features(part)
        return self._evidence(x), weights, lines

    def _logit(self, texts: list[bytes | None]) -> np.ndarray:
        out = [np.empty(0)]
        for part in in_parts(texts):
            q = np.clip(self.chain.quality_of(*self._lines(part)), 1e-4, 1 - 1e-4)
            out.append(np.log(q / (1 - q)))
        return np.concatenate(out)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self._logit(texts) * self.curve[0] + self.curve[1])))

    def lines(self, text: bytes | None) -> np.ndarray:
        """The chance of each line of a text to be good."""
        s, _, lines = self._lines([text])
        return self.chain.marginals_of(s, lines)[0]


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES, sample_text: int = SAMPLE_TEXT) -> Model:
    """The model of at most ``sample`` labelled documents outside the held-out fold."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.groupBy("label_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)  # at most ``sample`` pairs of numbers: small enough to broadcast
    rows = docs.select(F.col(id_col).cast("bigint").alias("label_id"), F.col(text_col).cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_text)
    rows = rows.join(F.broadcast(chosen), "label_id").groupBy("label_id", "quality").agg(F.min("text").alias("text"))
    before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).over(Window.orderBy(F.xxhash64("label_id"), "label_id"))  # over ``sample`` rows at most
    rows = rows.withColumn("before", before).filter(F.col("before") <= sample_bytes).drop("before").collect()
    rows.sort(key=lambda r: (hash((r.label_id * 2654435761) & 0xFFFFFFFF), r.label_id))
    return Model([r.text.encode() if r.text else None for r in rows], np.array([r.quality for r in rows]))


def _scored(model):
    def make():
        m = model.value

        def each(batch: pa.RecordBatch):
            s = m.scores(binary(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

        return each

    return make


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on)."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = map_batches(rows, _scored(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that the classifier accepts, with their own columns; each row is judged where it stands, without a join."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))
    (s,) = fresh(docs, "quality_score")

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.value.scores([t.encode() if t else None for t in texts]), dtype="float64")

    return docs.withColumn(s, score(F.col(text_col).cast("string"))).filter(F.col(s) >= threshold).select(*docs.columns)

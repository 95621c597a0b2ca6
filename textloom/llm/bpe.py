"""Byte-level BPE by a backtracking encoder, and decoding by an offset table.

Encoding. An Aho-Corasick automaton over all tokens finds the longest token that starts at each byte of a pre-token. The encoder walks
forward with these longest matches. Two neighbours are allowed only if BPE itself would leave them apart; the table of pairs
tells that. If no match fits, it takes the next shorter token (the table of prefixes), and if there is none it goes
back over the last token; positions from which nothing led on are marked, so each is left at most once. Each prefix has one
valid token sequence, hence the result is what applying the merges in order gives.

Pairs. While BPE works on two neighbours a|b, the token at the end of a is one of a's right spine (a, its right half, that one's right half
...), and the token at the start of b one of b's left spine. Each lives from its own merge to its parent's. The neighbours stay
apart exactly if no merge of two such tokens falls into both lives (with equal ranks the left merge comes first).

Decoding. All tokens' bytes stand in one buffer, with an offset for each id; the ids' ranges are gathered at once.

Defined results: a null text counts as empty and gives no ids. Strings of added tokens in a text become their ids. Bytes that are
not UTF-8 decode to the replacement character. Rows keep their order and multiplicity; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import Pieces, gathered, in_turn, parts
from textloom.llm.common import map_batches
from textloom.session import ship

#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where Latin-1 prints it, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """``spec``: the text of a tokenizer file with a byte-level BPE model."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s).decode("latin-1")
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        vocab = model["model"]["vocab"]
        self.id_of = {raw(s): i for s, i in vocab.items() if s not in added}
        self.rank: dict[tuple[str, str], int] = {}
        halves: dict[str, tuple[str, str]] = {}
        for r, m in enumerate(model["model"]["merges"]):
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.rank[x, y] = r
            halves.setdefault(x + y, (x, y))
        self._halves = halves
        self._right: dict[str, list[tuple[str, float]]] = {}
        self._left: dict[str, list[tuple[str, float]]] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        usable = {t for t in self.id_of if len(t) == 1}
        for t in sorted((t for t in self.id_of if t in halves), key=lambda t: self.rank[halves[t]]):
            x, y = halves[t]
            if x in usable and y in usable and self._stay_apart(x, y, self.rank[x, y]):
                usable.add(t)
        self.automaton = ahocorasick.Automaton()
        for t in usable:
            self.automaton.add_word(t, (t, len(t) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        for t in usable:
            self.shorter[t] = next((t[:k] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), None)
        self.added = added
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._pre = regex.compile(PRE_TOKENS)
        size = max([*self.id_of.values(), *added.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = {t: np.array(i, self.dtype).tobytes() for t, i in self.id_of.items()}
        spelled = [b""] * size
        for t, i in self.id_of.items():
            spelled[i] = t.encode("latin-1")
        for t, i in added.items():
            spelled[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)
        each = in_turn(self.encode_bytes, self.dtype)
        self.words = Pieces(each, each, self.dtype)
        decimals = [b"%d," % i for i in range(size)]
        self.decimal_offsets = np.concatenate([[0], np.cumsum(list(map(len, decimals)))])
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self._pieces: dict[str, bytes] = {}

    def _spine(self, token: str, side: int, kept: dict) -> list[tuple[str, float]]:
        """Tokens on one side of a token's merge tree, each with the rank at which its parent swallows it."""
        got = kept.get(token)
        if got is None:
            got, t, until = [], token, float("inf")
            while True:
                got.append((t, until))
                if t not in self._halves:
                    break
                until = self.rank[self._halves[t]]
                t = self._halves[t][side]
            kept[token] = got
        return got

    def _stay_apart(self, a: str, b: str, before: float) -> bool:
        """Whether no merge across the border of a|b comes before rank ``before``."""
        for x, x_until in self._spine(a, 1, self._right):
            for y, y_until in self._spine(b, 0, self._left):
                r = self.rank.get((x, y))
                if r is not None and r < before and r < x_until and r <= y_until:
                    return False
        return True

    def compatible(self, a: str, b: str) -> bool:
        got = self._apart.get((a, b))
        if got is None:
            if len(self._apart) > 150_000:
                self._apart.clear()
            got = self._apart[a, b] = self._stay_apart(a, b, float("inf"))
        return got

    def encode_pretoken(self, piece: str) -> bytes:
        """Ids, in bytes, of one pre-token, given as bytes in Latin-1."""
        n = len(piece)
        longest: list[str | None] = [None] * n
        for end, (t, back) in self.automaton.iter(piece):
            longest[end - back] = t  # matches come by their ends, so the last is the longest
        out: list[str] = []
        dead: set[int] = set()
        at, t = 0, longest[0]
        while at < n:
            while t is not None and (at + len(t) in dead or (out and not self.compatible(out[-1], t))):
                t = self.shorter[t]
            if t is not None:
                out.append(t)
                at += len(t)
                t = longest[at] if at < n else None
            else:
                dead.add(at)
                t = out.pop()
                at -= len(t)
                t = self.shorter[t]
        return b"".join([self.packed[t] for t in out])

    def _plain(self, text: str) -> bytes:
        out = []
        for p in self._pre.findall(text):
            got = self._pieces.get(p)
            if got is None:
                if len(self._pieces) > 50_000:
                    self._pieces.clear()
                got = self.encode_pretoken(p.encode().decode("latin-1"))
                if len(p) < 64:
                    self._pieces[p] = got
            out.append(got)
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        if self._cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], self.dtype).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(self._cut.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return self.words.one(text)

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, end to end, and how many each id has."""
        start = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - start
        return gathered(self.buffer, start, sizes), sizes

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(ids)[0].tobytes().decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of documents whose ids stand end to end."""
        data, length = self.spelled(ids)
        return [x.decode("utf-8", "replace") for x in _cut_up(data.tobytes(), length, sizes)]

    def in_decimal(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of each document as decimal numbers, joined by commas."""
        start = self.decimal_offsets[ids]
        length = self.decimal_offsets[ids.astype(np.int64) + 1] - start
        return [x[:-1] for x in _cut_up(gathered(self.decimals, start, length).tobytes(), length, sizes)]


def _cut_up(data: bytes, length: np.ndarray, sizes: np.ndarray):
    """The bytes of each document, where each id has ``length`` bytes and each document ``sizes`` ids."""
    at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield data[a:b]


_loaded: dict[str, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """One encoder a worker and vocabulary, kept from task to task."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def _encoded(bpe: Bpe, batch: pa.RecordBatch):
    """Parts of a batch: doc_ids, texts, all ids and how many each document has."""
    at = 0
    for texts in parts(batch.column("text")):
        yield batch.column("doc_id").slice(at, len(texts)), texts, *bpe.words.of(texts)
        at += len(texts)


def _with_ids(spec, with_text):
    def make():
        bpe = loaded(spec.value)

        def each(batch: pa.RecordBatch):
            for doc_ids, texts, ids, sizes in _encoded(bpe, batch):
                decoded = bpe.decode_all(ids, sizes)
                if decoded != texts.to_pylist():
                    raise ValueError("a text does not come back from its ids")
                cols = {
                    "doc_id": doc_ids,
                    "n_tokens": pa.array(sizes),
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32))),
                    "round_trip": pa.array(np.ones(len(sizes), bool)),
                }
                if with_text:
                    cols["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(cols)

        return each

    return make


def _digests(spec):
    def make():
        bpe = loaded(spec.value)

        def each(batch: pa.RecordBatch):
            for doc_ids, _, ids, sizes in _encoded(bpe, batch):
                ids_sha = [hashlib.sha256(x).hexdigest() for x in bpe.in_decimal(ids, sizes)]
                text_sha = [hashlib.sha256(x.encode()).hexdigest() for x in bpe.decode_all(ids, sizes)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return make


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_tokens, ids, round_trip (decoding gave the text again, always true: a text that doesn't come back stops the job) and, if asked for, the decoded text.

    ``vocabulary``: path of the tokenizer file on the driver; its text (a few MB, whatever the input) is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    schema = "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean" + ", decoded string" * with_text
    return map_batches(_rows(docs, id_col, text_col), _with_ids(spec, with_text), schema)


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, digested where they are made, so that the ids don't leave the task."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    return map_batches(_rows(docs, id_col, text_col), _digests(spec), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

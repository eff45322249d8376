"""Byte-level BPE encoding with a public vocabulary, by backtracking over longest matches.

An Aho-Corasick automaton over all tokens gives the longest token that starts at each byte. The
encoder goes from left to right, takes the longest token that is compatible with the one before
it, and steps back where none is. Two adjacent tokens are compatible if merging their joined
bytes by rank yields just these two; as every prefix of a text has exactly one last token in its
encoding, a place that failed once fails always, so each place is left at most once and the time is linear.
The ids are exactly those of repeated merging in rank order. Decoding slices one byte blob by an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Folder of the vocabulary files; a parameter of every operator here.
VOCABULARIES = os.environ.get("SEAMLINE_TOKENIZERS", "/opt/tokenizers")

#: Most entries a worker keeps of the pair table and of encoded pieces before it starts afresh.
MEMO = 500_000


@lru_cache(maxsize=4)
def load_tokens(path: str) -> tuple[bytes, ...]:
    """The tokens of a .tiktoken file, by id; ids must be dense and in merge order."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    tokens = [b""] * len(pairs)
    for rank, token in pairs:
        tokens[rank] = token
    return tuple(tokens)


class Vocabulary:
    """Tables of one vocabulary: lengths, the pair each token is merged from, the next shorter prefix, the decode blob."""

    def __init__(self, tokens: tuple[bytes, ...]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        self.length = [len(t) for t in tokens]
        self.left, self.right, self.shorter = list(range(n)), list(range(n)), [-1] * n
        self.pairs: dict[int, int] = {}
        for i, t in enumerate(tokens):
            for k in range(len(t) - 1, 0, -1):
                if (p := ids.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
            if len(t) > 1:
                self.left[i], self.right[i] = self._merged_from(t, i, ids)
                self.pairs[self.left[i] * n + self.right[i]] = i
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.blob = b"".join(tokens)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.find = regex.compile(PATTERN).findall

    @staticmethod
    def _merged_from(token: bytes, rank: int, ids: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens left when `token` is merged with all ranks below its own."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = ids.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {rank} can't be made by merging")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ids[parts[0]], ids[parts[1]]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between a and b: undo merges on both sides of it, latest first.

        At each step the tokens at the border are those present before merge number `limit`; a merge across the
        border with a lower number would have come first.
        """
        n, limit = len(self.tokens), len(self.tokens)
        while True:
            if self.pairs.get(a * n + b, limit) < limit:
                return False
            if a > b:  # a was merged last: go back to before that
                limit = a
                part = self.right[a]
                if part == a:
                    return True
                a = part
            else:
                # On equal ids the left merge comes first, so the right one is undone first and a merge made of `b` itself counts.
                limit = b + 1
                part = self.left[b]
                if part == b:
                    if a == b or self.right[a] == a:
                        return True
                    limit = a
                    a = self.right[a]
                else:
                    b = part

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as one character per byte."""
        n = len(piece)
        length, shorter, ok, width = self.length, self.shorter, self.compatible, len(self.tokens)
        longest = [0] * n
        for end, token in self.automaton.iter(piece):
            longest[end - length[token] + 1] = token  # ends ascend, so the last one set is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if not out:
                        fits = True
                    else:
                        key = out[-1] * width + token
                        fits = ok.get(key)
                        if fits is None:
                            if len(ok) >= MEMO:
                                ok.clear()
                            fits = ok[key] = self._compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens (their strings are ordinary text); [] for null and empty."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for piece in self.find(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self._piece(piece.encode("utf-8", "replace").decode("latin-1"))
                if len(piece) <= 64:
                    if len(pieces) >= MEMO:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        offsets, blob = self.offsets, self.blob
        return b"".join(blob[offsets[i] : offsets[i + 1]] for i in ids or []).decode("utf-8", "replace")


_READY: dict[int, Vocabulary] = {}


def _vocabulary(tokens: tuple[bytes, ...]) -> Vocabulary:
    """The tables, built once per Python worker."""
    key = hash(tokens)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Vocabulary(tokens)
    return _READY[key]


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Vocabulary:
    return _vocabulary(load_tokens(f"{folder}/{name}.tiktoken"))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, counts_only: bool = False) -> DataFrame:
    """(id, ids), or with `counts_only` (id, n_tokens), of every row; [] or 0 for null and empty texts.

    The vocabulary (bounded: the file's tokens) is read on the driver and broadcast; rows are encoded whole, in Arrow
    batches, without a shuffle. Repeated rows come out repeated; a null id stays null; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_tokens(f"{folder}/{name}.tiktoken"))
    kind = dict(df.dtypes)[id_col]
    out_name = "n_tokens" if counts_only else "ids"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if counts_only:
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(vocab.encode(t.as_py())) for t in texts], pa.int64())], names=["id", out_name])
                continue
            start, flat, ends = 0, [], [0]
            for k, text in enumerate(texts):
                flat += vocab.encode(text.as_py())
                ends.append(len(flat))
                if len(flat) > 1_000_000 or k + 1 == len(texts):
                    values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, k + 1 - start), values], names=["id", out_name])
                    start, flat, ends = k + 1, [], [0]

    schema = f"id {kind}, {out_name} {'bigint' if counts_only else 'array<int>'}"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(id, text) of every row's ids; "" for null and empty lists."""
    shared = df.sparkSession.sparkContext.broadcast(load_tokens(f"{folder}/{name}.tiktoken"))
    kind = dict(df.dtypes)[id_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocab.decode(x.as_py()) for x in batch.column(1)], pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)

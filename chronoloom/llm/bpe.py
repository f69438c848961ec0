"""Byte-pair encoding and decoding of whole texts.

Encoding is by backtracking: an Aho-Corasick automaton over the vocabulary gives the longest token
at every position of a piece; tokens are taken from left to right, each checked against the one
before it by a pair-compatibility table (would the merges have left exactly these two tokens side
by side?); where no token fits, the last one is taken back and replaced by its next shorter prefix.
A bit for each position keeps a dead end from being tried twice, so the time is linear, and the
result is that of applying all merges in order. Decoding joins slices of one byte string that
holds all tokens, by a table of offsets.

Defined results: a null text has null ids and 0 tokens, an empty one no ids; each row is encoded
for itself, repeated rows and null doc_ids included (a doc_id that is no whole number becomes null);
other columns are not read. Special tokens
are not recognised: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache, segments, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of the characters below only, where the standard library agrees on classes.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ɏ]")
#: Pieces and pairs that a worker remembers; when full, they are forgotten and found again.
REMEMBERED = 300_000


def load_tokens(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str = TOKENIZER) -> tuple:
    """(version, tokens, left, right): the two tokens of which each token is merged, or itself."""
    tokens = load_tokens(path)
    rank = {t: i for i, t in enumerate(tokens)}
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], i))
                if rank.get(parts[best] + parts[best + 1], i) >= i:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                left[i], right[i] = rank[parts[0]], rank[parts[1]]
    return str(uuid.uuid4()), tokens, left, right


class Codec:
    """Encoder and decoder of one vocabulary, held by each Python worker."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int]):
        import ahocorasick
        import regex

        self.rank = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.left, self.right = left, right
        self.merged = {}
        for i, (a, b) in enumerate(zip(left, right)):
            if a != i:
                self.merged[(a, b)] = i
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1) for t in tokens]
        self.whole = {t for i, t in enumerate(tokens) if len(t) == 1 or left[i] != i}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if t in self.whole:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict = {}
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum(self.length))).astype(np.int64)
        self.split = regex.compile(PATTERN).findall
        self.split_plain = re.compile(PLAIN).findall
        self.pieces = Pieces(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave token a followed by token b as they are."""
        known = self.pairs.get(a << 20 | b)
        if known is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a << 20 | b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Undo merges next to the border, latest first: a merge across it that comes before the
        # one undone last would have happened in place of it.
        left, right, merged = self.left, self.right, self.merged
        before = len(left)
        while True:
            if merged.get((a, b), before) < before:
                return False
            if a > b:
                before = a
                a = right[a]
                if a != before:
                    continue
                # a is a single byte
                before, b = b + 1, left[b]
                if b + 1 == before:
                    return True
            else:
                before = b + 1
                b = left[b]
                if b + 1 != before:
                    continue
                before, a = a, right[a]
                if a == before:
                    return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.whole:
            return [self.rank[piece]]
        n, length, fits, shorter = len(piece), self.length, self.fits, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if open_[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            if token < 0:
                open_[at] = 0
                token = out.pop()
                at -= length[token]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Exact token counts of the first 0, 1, ..., n bytes of a piece.

        Exactly one token that ends at a position fits what comes before it, so the count there is
        the count at that token's start plus one.
        """
        n, length, known = len(piece), self.length, self.pairs.get
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if start:
                    before = last[start]
                    fit = known(before << 20 | token)
                    if fit is None:
                        fit = self.fits(before, token)
                    if not fit:
                        continue
                last[end] = token
                count[end] = count[start] + 1
        return count

    def encode(self, text: str) -> np.ndarray:
        split = self.split if NOT_PLAIN.search(text) else self.split_plain
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, split(text))), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        start = self.offset[ids]
        return self.blob[segments(start, self.offset[ids.astype(np.int64) + 1] - start)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", errors="replace")


class Pieces(dict):
    """Ids of pieces that have come, as bytes of 32-bit numbers."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[piece] = array("i", self.codec.encode_piece(piece.encode())).tobytes()
        return ids


def codec_of(vocabulary) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    version, *parts = vocabulary.value
    return process_cache("bpe-codec", lambda: Codec(*parts), version)


def _encode(vocabulary):
    def run(batches):
        codec = codec_of(vocabulary)
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                ids = [None if t is None else codec.encode(t) for t in text.to_pylist()]
                size = np.array([0 if x is None else len(x) for x in ids], np.int64)
                flat = np.concatenate([x for x in ids if x is not None]) if size.any() else np.zeros(0, np.int32)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                none = pa.array([x is None for x in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=none) if len(ids) else pa.array([], pa.list_(pa.int32()))
                # decode again, all rows at once
                start = codec.offset[flat]
                width = codec.offset[flat.astype(np.int64) + 1] - start
                data = codec.blob[segments(start, width)]
                border = np.concatenate(([0], np.cumsum(width)))[ends].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(border), pa.py_buffer(data)])
                exact = pc.equal(decoded, text.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size), lists, exact], ["doc_id", "n_tokens", "ids", "exact"])

    return run


def encode_documents(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every row; exact: decoding the ids gives the text's bytes.

    exact is null for a null text. The vocabulary, whose size is fixed, is read by the driver from
    `path` and broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(_encode(vocabulary), "doc_id long, n_tokens long, ids array<int>, exact boolean")


def _decode(vocabulary):
    def run(batches):
        codec = codec_of(vocabulary)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            text = [None if x is None or None in x else codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids, or a null among them, give a null text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    return encoded.select(F.col("doc_id").try_cast("long").alias("doc_id"), "ids").mapInArrow(_decode(vocabulary), "doc_id long, text string")

"""Token counts at every prefix of every text, by dynamic programming.

The last token of a prefix is the one token ending there that fits the last token before it, so the
count at a position is that at the token's start plus one: one pass gives the exact count of every
prefix. What is stored is the change of the count from each character to the next, in one byte
(`width` 1) or, where a change needs more, in four; sums of changes answer how many tokens a prefix
has and which is the longest prefix within a budget, without encoding again.

A text is split into units that don't depend on one another, wherever it is cut: white space with
the word, number or signs after it. White space at the end of a prefix is one piece, before a word
it is split, so both cases are counted for each unit.

Defined results: a null text has null changes and 0 tokens, an empty one empty changes; rows are
counted one by one, repeated rows and null doc_ids included (a doc_id that is no whole number becomes
null); other columns are not read.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NOT_PLAIN, REMEMBERED, TOKENIZER, codec_of, load_vocabulary
from .common import process_cache, slices

UNITS = r"\s*(?<! )'(?:[sdmt]|ll|ve|re)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
PLAIN_UNITS = r"\s*(?<! )'(?:[sdmt]|ll|ve|re)|\s*(?:[^\W\d_]+|[0-9]+|(?:[^\w\s]|_)+)|\s+"
CONTRACTIONS = frozenset(("'s", "'d", "'m", "'t", "'ll", "'ve", "'re"))
BUDGETS = (512, 2048, 8192)


def unit_counts(codec, unit: str) -> list[int]:
    """Token counts of the first 1, 2, ... characters of a unit."""
    core = unit.lstrip()
    space = unit[: len(unit) - len(core)]
    if space in ("", " ") and core and (space or core not in CONTRACTIONS):
        return _by_character(unit, codec.prefix_counts(unit.encode()))
    out = _by_character(space, codec.prefix_counts(space.encode())) if space else []
    if not core:
        return out
    if space.endswith(" "):
        before, head = space[:-1], " "
    else:
        before, head = space, ""
    base = 0
    if before:
        pieces = [before] if head or len(before) == 1 else [before[:-1], before[-1]]
        base = sum(codec.prefix_counts(p.encode())[-1] for p in pieces)
    if not head and core in CONTRACTIONS:
        for k in range(1, len(core)):
            parts = [core[:1], core[1:k]] if k > 1 else [core[:1]]
            out.append(base + sum(codec.prefix_counts(p.encode())[-1] for p in parts))
        out.append(base + codec.prefix_counts(core.encode())[-1])
        return out
    counts = _by_character(head + core, codec.prefix_counts((head + core).encode()))
    return out + [base + c for c in counts[len(head) :]]


def _by_character(text: str, counts: list[int]) -> list[int]:
    """Of counts by byte those at the ends of characters."""
    if text.isascii():
        return counts[1:]
    out, at = [], 0
    for c in text:
        at += len(c.encode())
        out.append(counts[at])
    return out


class Units(dict):
    """Changes of the count over units that have come; those that need more than a byte apart."""

    def __init__(self, codec):
        import regex

        self.codec, self.wide = codec, set()
        self.split, self.split_plain = regex.compile(UNITS).findall, re.compile(PLAIN_UNITS).findall

    def changes(self, unit: str) -> list[int]:
        counts = unit_counts(self.codec, unit)
        return [b - a for a, b in zip([0, *counts], counts)]

    def __missing__(self, unit: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        c = self.changes(unit)
        try:
            out = array("b", c).tobytes()
        except OverflowError:
            self.wide.add(unit)
            out = bytes(len(c))
        self[unit] = out
        return out

    def count(self, text: str) -> tuple[int, bytes]:
        """(width, changes) of a whole text."""
        units = self.split(text) if NOT_PLAIN.search(text) else self.split_plain(text)
        out = b"".join(map(self.__getitem__, units))
        if self.wide and not self.wide.isdisjoint(units):
            return 4, np.array([c for u in units for c in self.changes(u)], np.int32).tobytes()
        return 1, out


def counts_of(changes: bytes, width: int = 1) -> np.ndarray:
    """Token counts of the first 0, 1, ..., n characters."""
    c = np.frombuffer(changes, np.int8 if width == 1 else np.int32)
    return np.concatenate(([0], np.cumsum(c, dtype=np.int64)))


def tokens_at(changes: bytes, width: int, characters: int) -> int:
    """Exact token count of the first `characters` characters."""
    return int(np.frombuffer(changes, np.int8 if width == 1 else np.int32)[:characters].sum(dtype=np.int64))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens; counts may fall and rise."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _count(vocabulary, budgets):
    def run(batches):
        version = vocabulary.value[0]
        codec = codec_of(vocabulary)
        units = process_cache("bpe-units", lambda: Units(codec), version)
        names = ["doc_id", "n_chars", "n_tokens", "width", "changes"] + [f"chars_in_{b}" for b in budgets]
        for batch in batches:
            for part in slices(batch):
                cols: list[list] = [[] for _ in names[1:]]
                for t in part.column("text").to_pylist():
                    if t is None:
                        row = [None, 0, None, None] + [None] * len(budgets)
                    else:
                        width, changes = units.count(t)
                        counts = counts_of(changes, width)
                        row = [len(t), int(counts[-1]), width, changes]
                        # byte-level tokens: a text of few characters may have more tokens than that
                        most = int(counts.max())
                        row += [len(t) if most <= b else longest_within(counts, b) for b in budgets]
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()] + [pa.int64()] * len(budgets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return run


def prefix_token_counts(docs: DataFrame, path: str = TOKENIZER, budgets=BUDGETS) -> DataFrame:
    """(doc_id, n_chars, n_tokens, width, changes, chars_in_<budget>...) of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    schema = "doc_id long, n_chars long, n_tokens long, width int, changes binary" + "".join(f", chars_in_{b} long" for b in budgets)
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(_count(vocabulary, tuple(budgets)), schema)

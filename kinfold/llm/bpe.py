"""Encoding of whole texts with a byte-level BPE vocabulary.

A text is split into pre-tokens by the vocabulary's pattern, stretches of ASCII
by a faster engine. A pre-token seen before costs one lookup; a new one is
merged by :meth:`Encoder.merge`, whose steps each cost the same however long it
is: pairs wait in one bucket per merge rank, and a hierarchical bitmap finds
the next rank.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.session import ship

TOKENIZERS = os.environ.get("KINFOLD_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pre-token pattern of this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space by its Unicode property; Python's own class has more members.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A stretch of ASCII up to white space, its ASCII white space before it included, or any other piece; no token crosses their ends.
_PIECE = re.compile(f"(?:[\\t-\\r ]*[\\x00-\\x08\\x0e-\\x1f!-~\\x7f]+(?=[\\t-\\r ]))+|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# PATTERN over ASCII alone, for the faster of the two regex engines.
_ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
TOKENS_KEPT = 500_000
LONGEST_KEPT = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a file with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Buckets of positions by rank, and a bitmap of the ranks in use in levels of 64 bits."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank in use and its positions from left to right; they leave the queue."""
        top = self.top
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = b << 6 | (mid & -mid).bit_length() - 1
        low = self.low[a]
        bit = low & -low
        rank = a << 6 | bit.bit_length() - 1
        low ^= bit
        self.low[a] = low
        if not low:
            mid &= mid - 1
            self.mid[b] = mid
            if not mid:
                self.top = top & (top - 1)
        positions = self.buckets.pop(rank)
        if len(positions) > 1:
            positions.sort()
        return rank, positions


class Encoder:
    """Encodes texts of any length; keeps what short pieces and pre-tokens gave, up to a bound."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall
        self.find_ascii = re.compile(_ASCII).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty or null text."""
        if not text:
            return []
        if text.isascii():
            return self._ids(self.find_ascii(text))
        tokens: list[str] = []
        for piece in _PIECE.findall(text):
            tokens += (self.find_ascii if piece.isascii() else self.find)(piece)
        return self._ids(tokens)

    def _ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        extend, get = out.extend, self.known.get
        for token in tokens:
            ids = get(token)
            if ids is None:
                ids = self.merge(token.encode("utf-8", "replace"))
                if len(token) <= LONGEST_KEPT:
                    if len(self.known) >= TOKENS_KEPT:
                        self.known.clear()
                    self.known[token] = ids
            extend(ids)
        return out

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, get = RankQueue(), ranks.get
        push = queue.push
        for i in range(n - 1):
            rank = get(data[i : i + 2])
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, positions = queue.pop()
            for at, i in enumerate(positions):
                left, j = part[i], after[i]
                if left is None or j >= n or get(left + part[j]) != rank:
                    continue  # stale: one of the two has merged since
                left += part[j]
                part[i], part[j] = left, None
                k = after[i] = after[j]
                lower = False
                if k < n:
                    before[k] = i
                    new = get(left + part[k])
                    if new is not None:
                        push(new, i)
                        lower = new < rank
                h = before[i]
                if h >= 0:
                    new = get(part[h] + left)
                    if new is not None:
                        push(new, h)
                        lower |= new < rank
                if lower:  # a lower rank came up: the rest of this bucket waits for it
                    for p in positions[at + 1 :]:
                        push(rank, p)
                    break
        return [ranks[p] for p in part if p is not None]


_encoders: dict[int, Encoder] = {}


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(``id_col``, ``ids``) of every row; empty and null texts give an empty list, blank text is encoded as it is.

    No special tokens; their strings in a text are ordinary text. The file of
    the vocabulary (under 1 MB) is read on the driver and broadcast, so only
    the driver needs it. No shuffle: each text is encoded where it is read.
    """
    spark = df.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(Path(folder, f"{vocabulary}.tiktoken").read_bytes())
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(data.value)
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = Encoder(read_ranks(data.value))
        names = [id_col, "ids"]
        kind = pa.field("element", pa.int32(), nullable=False)
        for batch in batches:
            begin, flat, ends, total = 0, [], [0], 0
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py())
                total += len(ids)
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(total)
                if total > 4_000_000 or row == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)), type=pa.list_(kind))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, row + 1 - begin), lists], names=names)
                    begin, flat, ends, total = row + 1, [], [0], 0

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, schema)

"""Evaluation items that leaked into training documents, wholly or in part.

Every task indexes the documents it reads as training shards: an FM-index over
all words of a shard, with a wavelet matrix for ranks and sampled suffix
positions; words that no item has are one symbol that nothing matches.
All phrases of the test items are searched backwards in it at once, their
occurrences located, and neighbouring occurrences merged to spans. A document
holds an item if its spans, in the item's order, cover half of the item's words.

The items are broadcast in parts of a checked size, one for any usual set of
items; documents are read once a part, never shuffled and never leave their task.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinfold.session import ship

PHRASE = 3
SHARE = 0.5
SHARD_WORDS = 2_000_000
SAMPLE = 8
PHRASES_AT_ONCE = 1 << 16
#: Items are broadcast in parts of about so many characters.
MAX_ITEM_CHARS = 64_000_000
LONGEST_SWAP = 16
DOC_END = -1

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbfv0])")


def words_of(text: str) -> list[str]:
    """Lower-case words; layout, punctuation, comment marks and escaping leave no trace."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


class FMIndex:
    """Words as integers from 1; 0 separates runs. Searches and locates many phrases at once."""

    def __init__(self, stream: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        n = len(stream)
        order = self._suffixes(stream, sigma)
        previous = stream[order - 1]  # of the first suffix, the last symbol: a separator ends the stream
        self.levels = max(1, int(sigma).bit_length())
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(stream, minlength=sigma + 2))])
        self.rank1: list[np.ndarray] = []
        column = previous
        for level in range(self.levels - 1, -1, -1):
            bits = (column >> level) & 1
            self.rank1.append(np.concatenate([[0], np.cumsum(bits)]))
            column = np.concatenate([column[bits == 0], column[bits == 1]])
        # positions are kept for every `sample`-th place and for the first place of each run, so no walk meets a separator
        kept = (order % sample == 0) | (previous == 0)
        self.kept, self.kept_rank = kept, np.cumsum(kept) - 1
        self.positions = order[kept]
        self.n = n

    @staticmethod
    def _suffixes(stream: np.ndarray, sigma: int) -> np.ndarray:
        """The suffix array by prefix doubling; only suffixes that still tie are sorted again.

        As many symbols as fit into an integer make the first key. Separators
        differ by place, so suffixes equal up to one keep the order of places.
        """
        n, bits = len(stream), max(1, int(sigma).bit_length())
        k = max(1, 62 // bits)
        key, whole = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(k):
            symbols = np.zeros(n, dtype=np.int64)
            symbols[: max(0, n - j)] = stream[j:]
            whole &= symbols > 0
            key = key << bits | np.where(whole, symbols, 0)
        order = np.argsort(key, kind="stable")
        key, whole, places = key[order], whole[order], np.arange(n)
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        begin = np.maximum.accumulate(np.where(new[:-1], places, 0))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.where(whole, begin, places)
        tied = np.flatnonzero(whole & ~(new[:-1] & new[1:]))
        while len(tied):
            at = order[tied]
            key = begin[tied] * (n + 1) + rank[at + k]
            again = np.argsort(key, kind="stable")
            at, key = at[again], key[again]
            new = np.concatenate([[True], key[1:] != key[:-1], [True]])
            order[tied] = at
            begin[tied] = tied[np.maximum.accumulate(np.where(new[:-1], np.arange(len(tied)), 0))]
            rank[at] = begin[tied]
            tied = tied[~(new[:-1] & new[1:])]
            k *= 2
        return order

    def _rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row."""
        low, high = np.zeros_like(rows), rows
        for level, rank1 in zip(range(self.levels - 1, -1, -1), self.rank1):
            ones = (symbols >> level) & 1 == 1
            zeros = self.n - rank1[-1]
            a, b = rank1[low], rank1[high]
            low = np.where(ones, zeros + a, low - a)
            high = np.where(ones, zeros + b, high - b)
        return high - low

    def _step(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer."""
        symbols, at = np.zeros_like(rows), rows
        low = np.zeros_like(rows)
        for level, rank1 in zip(range(self.levels - 1, -1, -1), self.rank1):
            ones = rank1[at + 1] - rank1[at] == 1
            zeros = self.n - rank1[-1]
            at = np.where(ones, zeros + rank1[at], at - rank1[at])
            low = np.where(ones, zeros + rank1[low], low - rank1[low])
            symbols |= ones.astype(symbols.dtype) << level
        return self.begin[symbols] + at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``phrases`` the range of suffixes that begin with it."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[:, k]
            low = self.begin[symbols] + self._rank(symbols, low)
            high = self.begin[symbols] + self._rank(symbols, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the stream of each suffix."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, at, walked = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.kept[at]
            out[open_[done]] = self.positions[self.kept_rank[at[done]]] + walked
            open_, at, walked = open_[~done], at[~done], walked + 1
            at = self._step(at) if len(at) else at
        return out


@dataclass
class Items:
    """The test items as word numbers, and all their phrases."""

    ids: list[int]
    texts: list[str]
    phrase: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    words: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for text in self.texts:
            self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)])
        self.sigma = len(self.vocabulary)
        n = self.phrase
        all_ = {tuple(w[k : k + n]) for w in self.words for k in range(len(w) - n + 1)}
        self.phrases = np.array(sorted(all_) or np.zeros((0, n)), dtype=np.int64).reshape(-1, n)
        number = {tuple(p): i for i, p in enumerate(self.phrases.tolist())}
        where: list[list[tuple[int, int]]] = [[] for _ in number]
        for i, w in enumerate(self.words):
            for k in range(len(w) - n + 1):
                where[number[tuple(w[k : k + n])]].append((i, k))
        self.where_begin = np.concatenate([[0], np.cumsum([len(x) for x in where])]).astype(np.int64)
        flat = [x for xs in where for x in xs]
        self.where_item = np.array([x[0] for x in flat], dtype=np.int64)
        self.where_at = np.array([x[1] for x in flat], dtype=np.int64)
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.flat = np.array([x for w in self.words for x in [*w, 0]] or [0], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)
        #: Items too short for a phrase, by their words: these are searched whole.
        self.short: dict[tuple[int, ...], list[int]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.short.setdefault(tuple(w), []).append(i)


def _located(index: FMIndex, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the phrase, place) of every occurrence of every phrase."""
    low, high = index.search(phrases)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    rows = np.arange(int(count.sum())) + np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count)
    return np.repeat(hit, count), index.locate(rows)


def _occurrences(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``words``, item, place in the item) of every phrase of every item, and of whole items shorter than a phrase."""
    kept = np.flatnonzero((words > 0) | np.concatenate([[True], words[:-1] > 0]))  # of unknown words in a row, one
    index = FMIndex(np.maximum(words[kept], 0), items.sigma)
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, dtype=np.int64),) * 3]
    for first in range(0, len(items.phrases), PHRASES_AT_ONCE):
        phrase, place = _located(index, items.phrases[first : first + PHRASES_AT_ONCE])
        phrase += first
        uses = items.where_begin[phrase + 1] - items.where_begin[phrase]
        slot = np.arange(int(uses.sum())) + np.repeat(items.where_begin[phrase] - np.concatenate([[0], np.cumsum(uses)[:-1]]).astype(np.int64), uses)
        out.append((np.repeat(kept[place], uses), items.where_item[slot], items.where_at[slot]))
    for text, own in items.short.items():
        _, place = _located(index, np.array([text], dtype=np.int64))
        for i in own:
            out.append((kept[place], np.full(len(place), i, dtype=np.int64), np.zeros(len(place), dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _chain(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (place in the document, place in the item, words), the heaviest that follow each other in both."""
    spans = sorted(spans)
    starts = sorted({s[1] for s in spans})
    best: list[tuple[int, int]] = [(0, -1)] * (len(starts) + 1)  # Fenwick tree of (weight, span) over ends in the item
    weight, back, pending = [0] * len(spans), [-1] * len(spans), []
    for i, (d, k, n) in enumerate(spans):
        while pending and pending[0][0] <= d:
            _, j = heapq.heappop(pending)
            p = bisect_right(starts, spans[j][1] + spans[j][2] - 1) + 1
            while p <= len(starts):
                best[p] = max(best[p], (weight[j], j))
                p += p & -p
        p, top = bisect_right(starts, k), (0, -1)
        while p:
            top = max(top, best[p])
            p -= p & -p
        weight[i], back[i] = top[0] + n, top[1]
        heapq.heappush(pending, (d + n, i))
    i, chain = max(range(len(spans)), key=lambda x: weight[x]), []
    while i >= 0:
        chain.append(spans[i])
        i = back[i]
    return chain[::-1]


def _merged(pair: np.ndarray, place: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place in the shard, place in the item, words) of phrases merged along their diagonals, sorted by pair."""
    diagonal = place - at
    order = np.lexsort((at, diagonal, pair))
    pair, place, at, size, diagonal = pair[order], place[order], at[order], size[order], diagonal[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + size[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return pair[first], place[first], at[first], at[last] + size[last] - at[first]


def _outward(words: np.ndarray, items: Items, doc: np.ndarray, item: np.ndarray, step: int) -> np.ndarray:
    """How many more words the text and an item share beyond an end of a span, for many spans at once.

    ``doc``, ``item``: the places next to the end in ``words`` and in the items'
    words. Two words in a row that differ end the walk, as do the ends of a
    document (-1) and of an item (0); a single one between words that agree
    counts as repeated.
    """
    total = np.zeros(len(doc), dtype=np.int64)
    missed = np.zeros(len(doc), dtype=bool)
    walking, d, k = np.arange(len(doc)), doc.copy(), item.copy()
    while len(walking):
        inside = (d >= 0) & (d < len(words)) & (k >= 0)
        walking, d, k = walking[inside], d[inside], k[inside]
        going = (items.flat[k] > 0) & (words[d] >= 0)
        walking, d, k = walking[going], d[going], k[going]
        same = words[d] == items.flat[k]
        total[walking[same]] += 1 + missed[walking[same]]
        go = same | ~missed[walking]
        missed[walking] = ~same
        walking, d, k = walking[go], d[go] + step, k[go] + step
    return total


def _alike(doc: list[int], item: list[int]) -> int:
    """Words of ``item`` that ``doc`` repeats here; a single word swapped between two that agree counts too."""
    if len(doc) == len(item):
        same = [a == b for a, b in zip(doc, item)]
        padded = [True, *same, True]
        return sum(1 for i, s in enumerate(same) if s or padded[i] and padded[i + 2])
    table = [0] * (len(item) + 1)
    for a in doc:
        diagonal = 0
        for j, b in enumerate(item):
            diagonal, table[j + 1] = table[j + 1], diagonal + 1 if a == b else max(table[j + 1], table[j])
    return table[-1]


def repeated_words(doc: list[int], item: list[int], spans: list[tuple[int, int, int]], before: dict[tuple, int], after: dict[tuple, int]) -> int:
    """How many words of ``item`` the document repeats in order.

    ``spans``: (place in the document, place in the item, words); ``before`` and
    ``after``: what lies beyond each span's ends.
    """
    chain = _chain(spans)
    total = sum(c[2] for c in chain) + before[chain[0]] + after[chain[-1]]
    for (d, k, m), (e, q, _) in zip(chain, chain[1:]):
        gap, there = q - k - m, e - d - m
        if 0 < gap <= LONGEST_SWAP and abs(gap - there) <= 2:
            total += _alike(doc[d + m : e], item[k + m : q])
    return total


def _find(items: Items, share: float):
    def shard(ids: list[int], sizes: list[int], flat: list[int]) -> tuple[list[int], list[int], list[float]]:
        words = np.array(flat, dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place, item, at = _occurrences(words, items)
        out: tuple[list, list, list] = ([], [], [])
        if not len(place):
            return out
        doc = np.searchsorted(begins, place, side="right") - 1
        pair, place, at, size = _merged(doc * len(items.ids) + item, place, at, np.minimum(items.phrase, items.lengths[item]))
        doc, item = pair // len(items.ids), pair % len(items.ids)
        before = _outward(words, items, place - 1, items.begins[item] + at - 1, -1)
        after = _outward(words, items, place + size, items.begins[item] + at + size, 1)
        cuts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.concatenate([cuts, [len(pair)]]))
        # no chain repeats more than all spans, what lies beyond the farthest-reaching of them, and the gaps between them
        most = np.add.reduceat(size, cuts) + np.maximum.reduceat(before, cuts) + np.maximum.reduceat(after, cuts) + (count - 1) * LONGEST_SWAP
        for c in np.flatnonzero(most >= share * items.lengths[item[cuts]]):
            lo, hi = int(cuts[c]), int(cuts[c] + count[c])
            d, i = int(doc[lo]), int(item[lo])
            own = flat[begins[d] : begins[d + 1]]
            spans = list(zip((place[lo:hi] - begins[d]).tolist(), at[lo:hi].tolist(), size[lo:hi].tolist()))
            part = repeated_words(own, items.words[i], spans, dict(zip(spans, before[lo:hi].tolist())), dict(zip(spans, after[lo:hi].tolist()))) / len(items.words[i])
            if part >= share:
                for column, value in zip(out, (ids[d], items.ids[i], part)):
                    column.append(value)
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.vocabulary.get
        ids: list[int] = []
        sizes: list[int] = []
        flat: list[int] = []

        def leave() -> pa.RecordBatch:
            a, b, c = shard(ids, sizes, flat)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["doc", "item", "share"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = len(flat)
                flat += [get(w, 0) for w in words_of(text.as_py())]
                flat.append(DOC_END)
                ids.append(i)
                sizes.append(len(flat) - before)
                if len(flat) >= SHARD_WORDS:
                    yield leave()
                    ids, sizes, flat = [], [], []
        if ids:
            yield leave()

    return find


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "item_text",
    share: float = SHARE, phrase: int = PHRASE, max_item_chars: int = MAX_ITEM_CHARS,
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``share``): documents that repeat at least ``share`` of an item's words in the item's order.

    ``share`` in the result is the part of the item's words that is repeated.
    A repetition holds at least one phrase of ``phrase`` words unchanged; items
    of fewer words count only where they are repeated whole. Null and wordless
    texts and items match nothing. Repeated documents each give their row.
    """
    spark = docs.sparkSession
    ship(spark)
    known_items = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    chars = known_items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = chars // max_item_chars + 1
    texts = docs.select(F.col(doc_id).cast("long"), F.col(doc_text)).where(F.col(doc_text).isNotNull())
    schema = T.StructType([T.StructField(doc_id, T.LongType()), T.StructField(item_id, T.LongType()), T.StructField("share", T.DoubleType())])

    def leaks_of(part: DataFrame) -> DataFrame:
        rows = part.collect()
        known = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], phrase))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _find(known.value, share)(batches):
                yield pa.RecordBatch.from_arrays(b.columns, names=[doc_id, item_id, "share"])

        return texts.mapInArrow(find, schema)

    in_part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    return reduce(DataFrame.union, [leaks_of(known_items.where(in_part == p)) for p in range(parts)])

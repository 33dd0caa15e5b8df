"""Frequency of every distinct value or term, counted in burst tries.

Each task counts the terms of its rows in a burst trie: terms gather in small
containers, and a container that outgrows its bound bursts into one container
per next character, so crowded prefixes get deep paths and sparse ones stay
flat. What a task emits is its containers, each with its prefix.

The routes to the merging tasks adapt to the whole collection: the containers'
sizes are added up by prefix, the prefixes that hold too much become crossings
(only these, at most ``MAX_CROSSINGS`` per length, come to the driver), and a
container goes down the crossings to its subtree; a small container of one
worker that lies above a crossing is cut up. Matching subtrees are then merged
with their occurrence and record counters added.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinfold.session import ship, written

BURST = 512
FLUSH = 1_000_000
ROUTE_TERMS = 20_000
MAX_CROSSINGS = 1024

_LEAVES = "field string, prefix string, terms array<string>, occurrences array<long>, records array<long>"


class BurstTrie:
    """Counts of terms; a node is a dict by next character (its depth under None), a container a dict of whole terms."""

    class Container(dict):
        __slots__ = ("depth",)

        def __init__(self, depth: int) -> None:
            super().__init__()
            self.depth = depth

    def __init__(self, burst: int = BURST, depth: int = 0) -> None:
        self.burst = burst
        self.root: dict = self.Container(depth)
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, key, above = self.root, "", None
        while type(node) is dict:
            above, at = node, node[None]
            key = term[at : at + 1]
            child = node.get(key)
            if child is None:
                child = node[key] = self.Container(at + 1)
            node = child
        state = node.get(term)
        if state is not None:
            state[0] += occurrences
            state[1] += records
            return
        node[term] = [occurrences, records]
        self.size += 1
        if len(node) > self.burst and not (above is not None and key == ""):
            burst = self._burst(node)
            if above is None:
                self.root = burst
            else:
                above[key] = burst

    def _burst(self, container: Container) -> dict:
        """One container per next character; the term that ends here stays in the container of no character."""
        node: dict = {None: container.depth}
        for term, state in container.items():
            key = term[container.depth : container.depth + 1]
            child = node.get(key)
            if child is None:
                child = node[key] = self.Container(container.depth + 1)
            child[term] = state
        return node

    def leaves(self) -> Iterator[tuple[str, Container]]:
        """Every container with the prefix all its terms share."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is dict:
                stack += [child for key, child in node.items() if key is not None]
            elif node:
                first = next(iter(node))
                yield first[: node.depth], node


def words(value: str) -> list[str]:
    """The non-empty pieces between ordinary spaces."""
    return [t for t in value.split(" ") if t]


def whole(value: str) -> list[str]:
    """The value itself, if it is not empty."""
    return [value] if value else []


def _batch(leaves: list[tuple[str, str, dict]]) -> pa.RecordBatch:
    rows = list(zip(*[(f, p, list(c), [s[0] for s in c.values()], [s[1] for s in c.values()]) for f, p, c in leaves])) or [[]] * 5
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["field", "prefix", "terms", "occurrences", "records"])


def _batches(trie: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    some: list[tuple[str, str, dict]] = []
    for field, t in trie.items():
        for prefix, container in t.leaves():
            some.append((field, prefix, container))
            if len(some) >= 256:
                yield _batch(some)
                some = []
    if some:
        yield _batch(some)


def _count_rows(fields: Sequence[str], splits: Sequence[Callable[[str], list[str]]], flush: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {f: BurstTrie() for f in fields}
        for batch in batches:
            for i, (field, split) in enumerate(zip(fields, splits)):
                add = tries[field].add
                for pair in pc.value_counts(batch.column(i)).to_pylist():
                    value, n = pair["values"], pair["counts"]
                    if value is None:
                        continue
                    terms = split(value)
                    if len(terms) == 1:
                        add(terms[0], n, n)
                    else:
                        for term, k in Counter(terms).items():
                            add(term, n * k, n)
            if sum(t.size for t in tries.values()) >= flush:  # states merge, so a full trie can leave and start anew
                yield from _batches(tries)
                tries = {f: BurstTrie() for f in fields}
        yield from _batches(tries)

    return count


def _crossings(leaves: DataFrame) -> set[tuple[str, str]]:
    """The prefixes below which more terms lie than one merging task should get; at most MAX_CROSSINGS of any length."""
    sizes = leaves.select("field", "prefix", F.size("terms").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(ROUTE_TERMS, math.ceil(total / MAX_CROSSINGS))
    above = sizes.select("field", "n", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("k"), "prefix")
    sums = above.groupBy("field", F.substring("prefix", F.lit(1), F.col("k")).alias("p")).agg(F.sum("n").alias("n"))
    return {(r[0], r[1]) for r in sums.where(F.col("n") > limit).select("field", "p").collect()}


def route(field: str, term: str, crossings: set[tuple[str, str]]) -> str:
    """The root of the subtree a term belongs to: one character below the last crossing on its path."""
    k = 0
    while k <= len(term) and (field, term[:k]) in crossings:
        k += 1
    return term[:k]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One container after the other, so that only one is held as Python objects."""
    columns = [batch.column(i) for i in range(5)]
    for row in range(batch.num_rows):
        yield tuple(c[row].as_py() for c in columns)


def _cut(crossings: set[tuple[str, str]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, dict]] = []
            for field, prefix, terms, occurrences, records in _rows(batch):
                if (field, prefix) not in crossings:
                    out.append((field, route(field, prefix, crossings), dict(zip(terms, zip(occurrences, records)))))
                    if len(out) >= 256:
                        yield _batch(out)
                        out = []
                    continue
                parts: dict[str, dict] = {}
                for term, a, b in zip(terms, occurrences, records):
                    parts.setdefault(route(field, term, crossings), {})[term] = (a, b)
                out += [(field, r, part) for r, part in parts.items()]
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return cut


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by route: the subtrees of one route become one, which leaves when the route ends."""

    def counted(field: str, trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        for _, c in trie.leaves():
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * len(c)), pa.array(list(c)), pa.array([s[0] for s in c.values()], pa.int64()), pa.array([s[1] for s in c.values()], pa.int64())],
                names=["field", "term", "n_occurrences", "n_records"],
            )

    at, trie = None, None
    for batch in batches:
        for field, prefix, terms, occurrences, records in _rows(batch):
            if (field, prefix) != at:
                if trie is not None:
                    yield from counted(at[0], trie)
                at, trie = (field, prefix), BurstTrie(depth=len(prefix))
            for term, a, b in zip(terms, occurrences, records):
                trie.add(term, a, b)
    if trie is not None:
        yield from counted(at[0], trie)


def term_statistics(df: DataFrame, splits: dict[str, Callable[[str], list[str]]], flush: int = FLUSH) -> DataFrame:
    """(``field``, ``term``, ``n_occurrences``, ``n_records``) of every term of every field.

    ``splits`` gives, for each column, the function that cuts a value into
    terms. A term is counted as often as it stands in a value, and once for
    each row that holds it. Nulls and values without a term give nothing;
    terms of any length and repeated rows are counted in full.
    """
    spark = df.sparkSession
    ship(spark)
    fields = list(splits)
    leaves = written(df.select(*fields).mapInArrow(_count_rows(fields, [splits[f] for f in fields], flush), _LEAVES), "leaves")
    routed = leaves.mapInArrow(_cut(_crossings(leaves)), _LEAVES)
    return (
        routed.repartition("field", "prefix").sortWithinPartitions("field", "prefix")
        .mapInArrow(_merge, "field string, term string, n_occurrences long, n_records long")
    )


def marked_terms(df: DataFrame, splits: dict[str, Callable[[str], list[str]]], rare: int = 2, common: float = 0.01) -> DataFrame:
    """:func:`term_statistics` with ``mark``: ``rare`` for at most ``rare`` rows, ``common`` for at least that share of all rows, else null.

    In a table so small that a term is both, it is ``common``.
    """
    least = math.ceil(Fraction(str(common)) * df.count())
    stats = term_statistics(df, splits)
    return stats.withColumn("mark", F.when(F.col("n_records") >= least, "common").when(F.col("n_records") <= rare, "rare"))

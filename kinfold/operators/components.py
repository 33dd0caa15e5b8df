"""Connected components: forests of what each task reads, then alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.operators.skew import HOT_ROWS, lookup_join
from kinfold.session import discard, ship, written

#: A task solves so many edges (16 bytes each) at a time and keeps one edge for each of their vertices.
LOCAL_EDGES = 1 << 18


def _forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of every vertex that is not the smallest: union-find by index."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    top = list(range(len(ids)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in zip(at[: len(src)].tolist(), at[len(src) :].tolist()):
        a, b = root(a), root(b)
        if a < b:
            top[b] = a
        elif b < a:
            top[a] = b
    low = ids[[root(i) for i in range(len(ids))]]
    return ids[low != ids], low[low != ids]


def _forests(local_edges: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def leave() -> pa.RecordBatch:
            src, dst = _forest(*(np.concatenate(x) for x in zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for b in batches:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= local_edges:
                yield leave()
                parts, size = [], 0
        if size:
            yield leave()

    return solve


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of the node and its neighbours. A hub's neighbours stay spread over tasks."""
    both = edges.union(edges.select(F.col("dst"), F.col("src")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return lookup_join(both.where("dst > src"), low, "src", hot_rows=hot_rows).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """A node and all its smaller neighbours link to the smallest of them. Edges point from larger to smaller."""
    low = edges.groupBy("src").agg(F.min("dst").alias("m"))
    others = lookup_join(edges, low, "src", hot_rows=hot_rows).where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return others.union(low.select("src", F.col("m").alias("dst"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has just that edge, and to a node that has none."""
    ends = edges.select("src", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("dst", F.lit(0), F.lit(1)))
    kinds = ends.groupBy("src").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return kinds.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component) of every node with an edge; ``component`` is its smallest id. Null ends and loops are skipped.

    Tasks first replace the edges they hold by forests, without a shuffle; what
    is left is dealt out to tasks of ``local_edges`` edges, which do so again;
    then rounds of stars until nothing changes. No task needs more than
    ``local_edges`` edges at a time or all edges of a hub.
    """
    ship(edges.sparkSession)
    a, b = edges.columns[:2]
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("src"), F.least(a, b).cast("long").alias("dst"))
    solved = "src long, dst long"
    first = written(pairs.mapInArrow(_forests(local_edges), solved).distinct(), "forests")
    tasks = -(-first.count() // local_edges) or 1
    current = written(first.coalesce(tasks).mapInArrow(_forests(local_edges), solved).distinct(), "forests")
    discard(first)
    while not _are_stars(current):
        large = written(_large_star(current, hot_rows), "large star")
        discard(current)
        current = written(_small_star(large, hot_rows), "small star")
        discard(large)
    return current.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(current.select("dst", "dst").distinct())


def label_all(ids: DataFrame, edges: DataFrame, **kwargs) -> DataFrame:
    """(id, component) of every id, its own component if it has no edge."""
    found = components(edges, **kwargs)
    return ids.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

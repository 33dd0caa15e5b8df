"""Pairwise matches into groups: connected components on a two-dimensional grid of edge partitions.

Vertices hash into ``B`` blocks and every edge lies in the cell (block, block)
of its two ends, so the whole edge set is a triangular grid of partitions. One
round is

1. local: each cell runs union-find over its own edges and yields, for every
   vertex it holds, the smallest vertex of its local component;
2. exchange: a vertex occurs in the cells of one row and one column; its parent
   is the smallest representative any of them gave;
3. every other representative it was given belongs to the same group: these
   (parent, representative) pairs are the edges of the next round.

Rounds go on until parents are stable, that is until no such pair is left; then
parents are followed from the last round back to the first. Every vertex with a
smaller neighbour gets a parent and only representatives go on, so the vertices
at least halve per round. ``B`` follows the number of edges: up to
``edges_per_cell`` of them in a cell, and as many cells as cores where these get
some thousand edges each. So the memory of a task is bounded, not by the graph,
and a vertex with very many edges spreads them over the ``B`` cells of its row
and column. A vertex that represents very many others is a hot key when parents
are followed; :func:`kinfold.operators.skew.lookup_join` leaves its rows spread
over the tasks. Nothing of the graph comes to the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kinfold.operators.skew import HOT_ROWS, lookup_join
from kinfold.session import discard, ship, written

EDGES_PER_CELL = 1 << 18
LEAST_PER_CELL = 1 << 12
SALTS = 32


def _local_roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of these edges and the smallest vertex of its component: union-find by index, path halving."""
    names, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = list(range(len(names)))
    half = len(src)
    for a, b in zip(ends[:half].tolist(), ends[half:].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:  # names are sorted: the smaller index is the smaller vertex
            parent[b] = a
        elif b < a:
            parent[a] = b
    up = np.array(parent, dtype=np.int64)
    while True:
        higher = up[up]
        if np.array_equal(higher, up):
            return names, names[up]
        up = higher


def _solve_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by cell; each cell is solved when its last edge was seen."""

    def solved(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        v, r = _local_roots(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "root"])

    cell, parts = None, []
    for batch in batches:
        cells, src, dst = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if parts and cells[lo] != cell:
                yield solved(parts)
                parts = []
            cell = cells[lo]
            parts.append((src[lo:hi], dst[lo:hi]))
    if parts:
        yield solved(parts)


def _grid_round(edges: DataFrame, blocks: int) -> DataFrame:
    """(v, root): what every cell says about its vertices."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cell = F.least(block("src"), block("dst")) * blocks + F.greatest(block("src"), block("dst"))
    n_cells = blocks * (blocks + 1) // 2
    return (
        edges.select(cell.alias("cell"), "src", "dst")
        .repartition(n_cells, "cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_solve_cells, "v long, root long")
    )


def connected_groups(edges: DataFrame, edges_per_cell: int = EDGES_PER_CELL, hot_rows: int = HOT_ROWS, least_per_cell: int = LEAST_PER_CELL) -> DataFrame:
    """(``id``, ``group_id``) of every vertex that has an edge to another one; ``group_id`` is the smallest id of the group.

    ``edges``: two columns of long, in any order and direction. Repeated and
    swapped edges count once, self edges and edges with a null end are skipped.
    No edge at all gives no rows.
    """
    spark = edges.sparkSession
    ship(spark)
    a, b = edges.columns[:2]
    current = written(
        edges.select(F.least(a, b).cast("long").alias("src"), F.greatest(a, b).cast("long").alias("dst"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("src") < F.col("dst"))).distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    cores = spark.sparkContext.defaultParallelism
    while n_edges := current.count():
        cells = max(1, n_edges / edges_per_cell, min(cores, n_edges / least_per_cell))
        stars = _grid_round(current, math.ceil(math.sqrt(2 * cells) - 0.5))
        stars = written(stars.withColumn("parent", F.min("root").over(W.partitionBy("v"))), "stars")  # a vertex has at most a row for each cell of its row and column
        rounds.append(stars.select("v", "parent").distinct())
        left = stars.where(F.col("root") != F.col("parent")).select(F.col("parent").alias("src"), F.col("root").alias("dst")).distinct()
        discard(current)
        current = written(left, "edges")
    discard(current)
    if not rounds:
        return spark.createDataFrame([], "id long, group_id long")
    result = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = written(result.select(F.col("v").alias("parent"), F.col("parent").alias("top")), "tops")
        result = lookup_join(written(earlier, "parents"), later, "parent", "left", hot_rows=hot_rows).select("v", F.coalesce("top", "parent").alias("parent"))
    return result.select(F.col("v").alias("id"), F.col("parent").alias("group_id"))


def star_edges(members: DataFrame, key_cols: list[str], id_col: str = "id", salts: int = SALTS) -> DataFrame:
    """(src, dst) edges that connect all ids sharing a key, one per row instead of all pairs.

    Two levels, so that no task gets a whole hot key: ids of a key link to the
    smallest of their salted part, the parts' smallest to the key's smallest.
    """
    salt = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(salts))
    parts = members.select(*key_cols, F.col(id_col).alias("dst"), salt.alias("salt"))
    inner = parts.withColumn("src", F.min("dst").over(W.partitionBy(*key_cols, "salt")))
    tops = parts.groupBy(*key_cols, "salt").agg(F.min("dst").alias("dst"))
    outer = tops.withColumn("src", F.min("dst").over(W.partitionBy(*key_cols)))
    return inner.select("src", "dst").union(outer.select("src", "dst")).where(F.col("src") < F.col("dst"))


def person_edges(people: DataFrame, links: DataFrame, filter_lists: DataFrame) -> DataFrame:
    """The connections of Person records: agreed links, shared addresses, shared names.

    Null arrays and null elements connect nothing; blank names and addresses
    connect nothing; a repeated element counts once. Links with a null id or an
    id that is not in ``people`` are dropped.
    """
    listed = filter_lists.select("list_name", F.lower(F.trim("entry")).alias("entry")).distinct()
    ids = people.select("id").where(F.col("id").isNotNull()).distinct()

    agreed = links.where(F.lower(F.trim("verdict")) == "same").select("id_a", "id_b").distinct()
    agreed = agreed.join(ids.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi")

    spaces = r"[\s\p{Z}]+"  # any kind of blank
    tidy = lambda c: F.trim(F.regexp_replace(c, spaces, " "))
    addresses = (
        people.select("id", F.explode("emails").alias("e"))
        .select("id", F.lower(F.regexp_replace(F.regexp_replace("e", rf"^{spaces}", ""), rf"{spaces}$", "")).alias("key"))
        .where(F.col("key") != "").distinct()
    )
    barred = listed.where(F.col("list_name").isin("emails", "popular_emails")).select(F.col("entry").alias("key")).distinct()
    addresses = addresses.join(barred, "key", "left_anti")

    popular = listed.where(F.col("list_name") == "popular_names").select(F.col("entry").alias("key"), F.lit(True).alias("popular"))
    names = (
        people.select("id", F.explode("names").alias("n"))
        .select("id", F.lower(tidy("n.name")).alias("key"), F.coalesce("n.repo", F.lit("")).alias("repo"))
        .where(F.col("key") != "").join(popular, "key", "left")
        .where(F.col("popular").isNull() | (F.col("repo") != ""))
        .select("id", "key", F.when(F.col("popular"), F.col("repo")).otherwise("").alias("repo")).distinct()
    )
    members = addresses.select("id", F.lit("e").alias("kind"), "key", F.lit("").alias("repo")).union(names.select("id", F.lit("n").alias("kind"), "key", "repo"))
    return agreed.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).union(star_edges(members, ["kind", "key", "repo"]))


def person_groups(people: DataFrame, links: DataFrame, filter_lists: DataFrame, **kwargs) -> DataFrame:
    """(``id``, ``group_id``) of each Person record in a group of at least two."""
    return connected_groups(person_edges(people, links, filter_lists), **kwargs)

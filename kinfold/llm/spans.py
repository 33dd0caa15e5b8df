"""Exact spans of at least ``length`` characters that stand in more than one record.

Windows are doubled level by level: only windows that repeat at one length are
looked at with twice the length (50, 100, 200 for ``length`` 200).

* The first level is thinned without loss: of any 151 windows of 50 characters
  in a row the one of smallest hash is an *anchor*, so every stretch of 200
  characters holds an anchor, at the same place in every copy.
* An anchor that stands in one record only is dropped. One whose whole
  surroundings (350 characters, all stretches of 200 around it) repeat in
  another record is settled at once: everything around it is shared.
* The rest lie near the end of a copied span. Their surroundings are fetched
  and the windows to the left and right of the anchor doubled: a shared stretch
  of 200 around an anchor holds the 100 characters from the anchor on or the 100
  up to its end, so only where one of these repeats the stretches of 200 are
  compared. Windows are grouped by hashes; what decides the result is then
  compared as text.

Aggregates carry the smallest and largest record of a window, never its list of
records, so a span copied into a third of all records is a few rows per task.
No key table is broadcast but those of hot keys, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from kinfold.operators.skew import HOT_ROWS, lookup_join
from kinfold.session import discard, ship, written

OUTSIDE = 0x110000  # stands for the places before and after a text
BLOCK = 1 << 19
#: An anchor with more different surroundings is spread over tasks; 350 characters each, so a task holds some megabytes of one.
GROUP_LIMIT = 8_000

_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Levels:
    """Window lengths derived from the length of a span: ``length`` is four times ``base``."""

    length: int = 200

    @property
    def base(self) -> int:
        return self.length // 4

    @property
    def reach(self) -> int:
        """How far a stretch of ``length`` around an anchor goes to either side of it."""
        return self.length - self.base


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows of twice the length from those of length ``k``."""
    out = h[:-k] * _M3
    out += h[k:]
    return _mixed(out)


def _window_hashes(codes: np.ndarray, lengths: list[int]) -> dict[int, tuple[np.ndarray, int, int]]:
    """For each length the hashes of a power of two of which two overlapping windows make it up: (hashes, power, shift)."""
    h, k, out = _mixed(codes.astype(np.uint64) * _M1 + _M4), 1, {}
    for n in sorted(lengths):
        while 2 * k <= n:
            h = _doubled(h, k)
            k *= 2
        out[n] = (h, k, n - k)
    return out


def _at(parts: tuple[np.ndarray, int, int], positions: np.ndarray | slice) -> np.ndarray:
    h, _, shift = parts
    if isinstance(positions, slice):
        out = h[: len(h) - shift] * _M4
        out += h[shift:]
    else:
        out = h[positions] * _M4
        out += h[positions + shift]
    return _mixed(out)


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` hashes in a row."""
    n = len(h)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = h
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(codes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the padded ``codes``, base hashes and hashes of the surroundings of all anchors.

    ``codes`` holds texts apart from each other by at least ``reach`` times
    OUTSIDE; anchors do not touch OUTSIDE.
    """
    base, reach = levels.base, levels.reach
    whole = base + 2 * reach
    hashes = _window_hashes(codes, [base, whole])
    h = _at(hashes[base], slice(None))
    outside = np.concatenate([[0], np.cumsum(codes == OUTSIDE)])
    inside = outside[base:] == outside[:-base]
    h = np.where(inside[: len(h)], h, np.iinfo(np.uint64).max)
    # least within some stretch of `length`: the largest of the minima of all windows that hold the position
    w = reach + 1
    minima = _window_minima(h, w)
    held = ~_window_minima(~np.concatenate([np.zeros(w - 1, np.uint64), minima, np.zeros(w - 1, np.uint64)]), w)
    at = np.flatnonzero((h == held) & inside[: len(h)])
    return at, h[at], _at(hashes[whole], at - reach)


def _find_anchors(levels: Levels, id_col: str):
    pad = np.full(levels.reach + levels.base, OUTSIDE, dtype=np.uint32)
    margin = 3 * levels.length

    def rows(ids: list[int], starts: list[int], cores: list[tuple[int, int]], shifts: list[int], sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        """starts: where each part begins in the padded block; cores: the places of the part whose anchors count; shifts: the part's place in its text."""
        at, low, whole = anchors(np.concatenate(parts), levels)
        part = np.searchsorted(np.array(starts), at, side="right") - 1
        local = at - np.array(starts)[part]
        core = np.array(cores)
        keep = (local >= core[part, 0]) & (local < core[part, 1])
        part, low, whole = part[keep], low[keep], whole[keep]
        pos = local[keep] + np.array(shifts)[part]
        ids_, sizes_ = np.array(ids, dtype=np.int64)[part], np.array(sizes)[part]
        # neighbours of one record with equal hashes (periodic text) become one row
        if len(pos):
            new = np.concatenate([[True], (ids_[1:] != ids_[:-1]) | (low[1:] != low[:-1]) | (whole[1:] != whole[:-1]) | (pos[1:] - pos[:-1] > levels.reach)])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:] - 1, [len(pos) - 1]])
        else:
            first = last = np.zeros(0, dtype=np.int64)
        columns = [low.view(np.int64)[first], whole.view(np.int64)[first], ids_[first], pos[first].astype(np.int32), pos[last].astype(np.int32), sizes_[first].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "w", "id", "first", "last", "n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state: list[list] = [[], [], [], [], [], [pad]]
            filled = len(pad)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = np.frombuffer(text.as_py().encode("utf-32-le"), dtype=np.uint32)
                for begin in range(0, len(codes), BLOCK):
                    lo, hi = max(0, begin - margin), min(len(codes), begin + BLOCK + margin)
                    for column, value in zip(state, (i, filled, (begin - lo, min(begin + BLOCK, len(codes)) - lo), lo, len(codes))):
                        column.append(value)
                    state[5] += [codes[lo:hi], pad]
                    filled += hi - lo + len(pad)
                    if filled >= BLOCK:
                        yield rows(*state)
                        state, filled = [[], [], [], [], [], [pad]], len(pad)
            if state[0]:
                yield rows(*state)

    return find


def _surroundings(levels: Levels):
    """(h, w, low, high, at, ctx, large) for each requested place of each text: the characters within reach of the anchor."""
    base, reach = levels.base, levels.reach

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for text, wanted in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                for r in wanted.as_py():
                    begin = max(0, r["first"] - reach)
                    for column, value in zip(out, (r["h"], r["w"], r["low"], r["high"], r["first"] - begin, text[begin : r["first"] + base + reach], r["large"])):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["h", "w", "low", "high", "at", "ctx", "large"])

    return cut


def _repeated(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows stand in more than one record: of each key the smallest and largest record differ."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begins = np.flatnonzero(first)
    more = np.minimum.reduceat(low[order], begins) != np.maximum.reduceat(high[order], begins)
    out = np.empty(len(keys), dtype=bool)
    out[order] = more[np.cumsum(first) - 1]
    return out


def double_sides(group: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, ctx: list[str], levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """For each class of surroundings how far the shared stretch goes to the left and right of its anchor; -1 if there is none.

    Classes of one ``group`` have the same anchor; whole groups must be given.
    """
    base, reach, n = levels.base, levels.reach, levels.length
    codes = np.full((len(ctx), base + 2 * reach), OUTSIDE, dtype=np.uint32)  # every anchor begins in column `reach`
    begin = reach - at
    end = begin.copy()
    for i, text in enumerate(ctx):
        own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        end[i] += len(own)
        codes[i, begin[i] : end[i]] = own
    h, k = _mixed(codes.astype(np.uint64) * _M1 + _M4), 1
    salt = _mixed((group.astype(np.int64).view(np.uint64) + np.uint64(1)) * _M2)

    def doubled_to(size: int) -> None:
        nonlocal h, k
        while 2 * k <= size:
            h = h[:, :-k] * _M3 + h[:, k:]
            h, k = _mixed(h), 2 * k

    def window(rows: np.ndarray, column: np.ndarray | int, size: int) -> np.ndarray:
        return _mixed(_mixed(h[rows, column] * _M4 + h[rows, column + size - k]) * _M3 + salt[rows])

    doubled_to(2 * base)
    alive = np.zeros(len(ctx), dtype=bool)
    for side, column in enumerate((reach, reach - base)):
        rows = np.flatnonzero((begin <= column) & (column + 2 * base <= end))
        if len(rows):
            alive[rows] |= _repeated(window(rows, column, 2 * base) + np.uint64(side), low[rows], high[rows])
    left = np.full(len(ctx), -1, dtype=np.int32)
    right = np.full(len(ctx), -1, dtype=np.int32)
    rows = np.flatnonzero(alive)
    if len(rows):
        doubled_to(n)
        back = np.arange(reach + 1)
        r, b = (x.ravel() for x in np.meshgrid(rows, back, indexing="ij"))
        inside = (begin[r] <= reach - b) & (reach - b + n <= end[r])
        r, b = r[inside], b[inside]
        if len(r):
            shared = _repeated(window(r, reach - b, n) + b.astype(np.uint64) * _M1, low[r], high[r])
            r, b = r[shared], b[shared].astype(np.int32)
            least = np.full(len(ctx), n, dtype=np.int32)
            np.maximum.at(left, r, b)
            np.minimum.at(least, r, b)
            right[r] = n - least[r]
            ends = np.unique(r)
            if not _same_text(codes, group, low, high, r, b, window(r, reach - b, n) + b.astype(np.uint64) * _M1, left, least, ends, reach, n):
                return _exact_sides(group, low, high, begin, end, codes, levels)
    return left, right


def _same_text(codes, group, low, high, r, b, keys, left, least, ends, reach: int, n: int) -> bool:  # noqa: ANN001
    """Whether the outermost windows of each class have the text of the windows that gave their key its smallest and largest record."""
    outer = np.flatnonzero((b == left[r]) | (b == least[r]))
    order = np.lexsort((low[r], keys))
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    smallest = np.empty(len(r), dtype=np.int64)
    smallest[order] = np.repeat(order[first], np.diff(np.concatenate([first, [len(r)]])))
    order = np.lexsort((-high[r], keys))
    largest = np.empty(len(r), dtype=np.int64)
    largest[order] = np.repeat(order[first], np.diff(np.concatenate([first, [len(r)]])))
    for other in (smallest, largest):
        x, y = outer, other[outer]
        if (group[r[x]] != group[r[y]]).any() or (b[x] != b[y]).any():
            return False
        for at in range(0, len(x), 4096):
            columns = (reach - b[x[at : at + 4096]])[:, None] + np.arange(n)
            if (codes[r[x[at : at + 4096]][:, None], columns] != codes[r[y[at : at + 4096]][:, None], columns]).any():
                return False
    return True


def _exact_sides(group, low, high, begin, end, codes, levels: Levels) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """:func:`double_sides` by the windows' texts themselves, for the case that two of them had one hash."""
    reach, n = levels.reach, levels.length
    records: dict[tuple[int, int, bytes], tuple[int, int]] = {}
    own: list[list[tuple[int, tuple]]] = []
    for i in range(len(group)):
        mine = []
        for back in range(reach + 1):
            if begin[i] <= reach - back and reach - back + n <= end[i]:
                key = (int(group[i]), back, codes[i, reach - back : reach - back + n].tobytes())
                a, z = records.get(key, (int(low[i]), int(high[i])))
                records[key] = (min(a, int(low[i])), max(z, int(high[i])))
                mine.append((back, key))
        own.append(mine)
    left, right = np.full(len(group), -1, dtype=np.int32), np.full(len(group), -1, dtype=np.int32)
    for i, mine in enumerate(own):
        backs = [back for back, key in mine if records[key][0] != records[key][1]]
        if backs:
            left[i], right[i] = max(backs), n - min(backs)
    return left, right


def _doubling(levels: Levels, at_once: int = 4096):
    """(h, w, left, right) of surroundings that come sorted by ``h``."""

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            h, w, low, high, at = (t.column(i).to_numpy() for i in range(5))
            left, right = double_sides(h, low, high, at.astype(np.int64), t.column(5).to_pylist(), levels)
            keep = left >= 0
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, w, left, right)], names=["h", "w", "left", "right"])

        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                h = batch.column(0).to_numpy()
                if size >= at_once and h[0] != kept[-1].column(0)[-1].as_py():
                    yield leave(kept)
                    kept, size = [], 0
                # up to the first new anchor after `at_once` rows
                new = np.flatnonzero(h[1:] != h[:-1]) + 1
                new = new[new >= max(1, at_once - size)]
                cut = int(new[0]) if len(new) else batch.num_rows
                kept.append(batch.slice(0, cut))
                size += cut
                batch = batch.slice(cut)
        if kept:
            yield leave(kept)

    return double


def _spread(ctx: DataFrame, levels: Levels) -> DataFrame:
    """:func:`double_sides` for anchors with very many different surroundings: windows are grouped over the cluster, by 128-bit hashes."""
    n, half, reach = levels.length, 2 * levels.base, levels.reach

    def windows(rows: DataFrame, places: list[int], size: int) -> DataFrame:
        """One row for each window of ``size`` characters that begins so many characters before the anchor and lies in the text."""
        one = lambda b: F.struct(F.lit(b).alias("back"), F.substring("ctx", F.col("at") - b + 1, F.lit(size)).alias("text"))
        inside = rows.select("h", "w", "low", "high", "at", F.length("ctx").alias("size"), F.explode(F.array(*[one(b) for b in places])).alias("x"))
        inside = inside.where((F.col("at") >= F.col("x.back")) & (F.col("at") - F.col("x.back") + size <= F.col("size")))
        return inside.select("h", "w", "low", "high", "x.back", F.xxhash64("x.text").alias("k1"), F.xxhash64(F.lit(n), "x.text").alias("k2"))

    def shared(rows: DataFrame) -> DataFrame:
        key = ["h", "back", "k1", "k2"]
        more = rows.groupBy(*key).agg(F.min("low").alias("a"), F.max("high").alias("b")).where(F.col("a") != F.col("b")).select(*key)
        return rows.join(more, key)

    alive = written(shared(windows(ctx, [0, levels.base], half)).select("h", "w").distinct(), "alive")
    found = shared(windows(ctx.join(alive.hint("shuffle_hash"), ["h", "w"], "left_semi"), list(range(reach + 1)), n))
    return found.groupBy("h", "w").agg(F.max("back").cast("int").alias("left"), (F.lit(n) - F.min("back")).cast("int").alias("right"))


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = 200, group_limit: int = GROUP_LIMIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``id_col``, ``start_pos``, ``end_pos``): each longest unbroken run of characters that lie in a shared stretch.

    A stretch of ``length`` characters (a multiple of 4) is shared if it stands,
    exactly, in a record with another id. Positions count code points from 0,
    the end is exclusive. Null texts, texts shorter than ``length`` and
    records without an id have no run; a text repeated under its own id is not shared by that.
    """
    if length % 4:
        raise ValueError("length must be a multiple of 4")
    spark, levels = df.sparkSession, Levels(length)
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where((F.length("text") >= length) & F.col("id").isNotNull())
    found = written(docs.mapInArrow(_find_anchors(levels, id_col), "h long, w long, id long, first int, last int, n int"), "anchors")

    repeated = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where(F.col("a") != F.col("b")).select("h")
    repeated = written(repeated, "repeated")
    live = written(lookup_join(found, repeated.hint("shuffle_hash"), "h", hot_rows=hot_rows), "live")
    discard(found, repeated)

    classes = written(live.groupBy("h", "w").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("first", "id").alias("first")), "classes")
    settled = classes.where(F.col("low") != F.col("high")).select("h", "w", F.lit(levels.reach).alias("left"), F.lit(length).alias("right"))
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("low") == F.col("high")).alias("open"))
    sizes = written(sizes.where("open and size > 1").select("h", "size"), "open")
    request = F.struct("h", "w", "low", "high", "first", (F.col("size") > group_limit).alias("large"))
    wanted = lookup_join(classes, sizes.hint("shuffle_hash"), "h", hot_rows=hot_rows).groupBy(F.col("low").alias("id")).agg(F.collect_list(request).alias("wanted"))
    wanted = written(wanted, "wanted")
    ctx = docs.join(wanted.hint("shuffle_hash"), "id").select("text", "wanted")
    ctx = written(ctx.mapInArrow(_surroundings(levels), "h long, w long, low long, high long, at int, ctx string, large boolean"), "surroundings")
    discard(wanted)
    usual = ctx.where("NOT large").drop("large").repartition("h").sortWithinPartitions("h")
    ends = usual.mapInArrow(_doubling(levels), "h long, w long, left int, right int")
    large = ctx.where("large").drop("large")
    if not large.isEmpty():
        ends = ends.union(_spread(large, levels))
    # a settled class is shared as far as a stretch can reach, so what its group found for it adds nothing
    reached = written(settled.union(ends.join(settled.hint("shuffle_hash"), ["h", "w"], "left_anti")), "reached")
    discard(ctx, sizes, classes)

    runs = lookup_join(live, reached.hint("shuffle_hash"), ["h", "w"], hot_rows=hot_rows).select(
        "id",
        F.greatest(F.col("first") - F.col("left"), F.lit(0)).alias("begin"),
        F.least(F.col("last") + F.col("right"), F.col("n")).alias("end"),
    )
    before = F.max("end").over(W.partitionBy("id").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1))
    parts = runs.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1))
    numbered = parts.withColumn("run", F.sum("new").over(W.partitionBy("id").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("begin").cast("long").alias("start_pos"), F.max("end").cast("long").alias("end_pos")).select(F.col("id").alias(id_col), "start_pos", "end_pos")

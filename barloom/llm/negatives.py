"""Hard negatives by secondary sort.

Anchors are scored against all rows by integer inner products. The scores that can matter are packed into rows keyed by (anchor,
descending score, kind, id), dealt by anchor and sorted inside partitions (repartition and sortWithinPartitions, the
DataFrame form of repartitionAndSortWithinPartitions), and one pass over each partition streams them: a positive opens a
window of scores, and each negative is given to the open windows that it lies in. What the pass holds is the windows of
one anchor, never its scores.

Scoring is a grid: rows are dealt into groups, anchors into blocks, and each cell of the grid streams its rows past its
block of anchors. A cell passes on only what may be among the first of the whole table: first its best POSITIVES scores of
the anchor's own label, and, once the positives are known, its best NEGATIVES scores of each positive's window. Both
are exact, as what is first in the whole table is first in its cell as well.

Cases: rows with null label, null vector or a null or non-finite component take no part; a shorter vector counts as padded with
zeros; rows that agree in id, label and vector count once; rows of an anchor's own id aren't its partners, and an id
with different vectors is an anchor once for each; null ids are partners that
come last among equal scores, but no anchors; ties are settled by id, then by a hash of label and vector; an empty table gives an
empty result; other columns play no part. A negative positive_score has no window, and one of 0 takes scores of 0. Products are
exact: in double precision below 2 ** 53, otherwise in Python's integers, held inside 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

POSITIVES, NEGATIVES = 5, 10
#: A window: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 30, 90
#: Rows of a group and anchors of a block, about.
ROWS, ANCHORS = 8192, 1024
#: Rows that meet a block of anchors at once.
CHUNK = 1024


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def labelled(rows: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, v): the rows that take part, each once."""
    own = rows.filter(usable(F.col(label), F.col(vector))).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised(F.col(vector)).alias("v"))
    return own.distinct()


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix of at least `width` columns, padded with zeros."""
    ends = np.asarray(vectors.offsets)
    flat, sizes = np.asarray(vectors.values)[ends[0] : ends[-1]], np.diff(ends)
    if sizes.size and (sizes == sizes[0]).all() and sizes[0] >= width:
        return flat.reshape(sizes.size, -1)
    out = np.zeros((sizes.size, max(width, sizes.max(initial=0))))
    out[np.repeat(np.arange(sizes.size), sizes), np.arange(flat.size) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as 64-bit integers."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape) for m in (a, b))
    end = 1 << 63
    return np.array([[max(-end, min(end - 1, int(v))) for v in r] for r in x.dot(y.T).tolist()], np.int64).reshape(len(a), len(b))


_OUT = pa.schema([("anchor", pa.int64()), ("twin", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("other", pa.int64())])
_least, _most = -(1 << 63), (1 << 63) - 1


class _Block:
    """Anchors of a cell, and for each of their windows the first k rows seen so far: by descending score, id (null last), twin.

    negatives: windows are those of the positives' scores and rows are of other labels; otherwise an anchor has one open
    window for rows of its own label.
    """

    def __init__(self, k: int, negatives: bool) -> None:
        self.k, self.negatives, self.keys, self.vectors, self.labels, self.windows = k, negatives, [], [], [], []

    def add(self, part: pa.RecordBatch) -> None:
        self.keys += zip(part.column("id").to_pylist(), part.column("twin").to_pylist())
        self.labels += part.column("label").to_pylist()
        self.vectors += list(_matrix(part.column("v"), 0))
        self.windows += part.column("windows").to_pylist() if self.negatives else [None] * part.num_rows

    def close(self) -> None:
        """No more anchors: lay out vectors and windows."""
        dim, n = max(v.size for v in self.vectors), len(self.keys)
        self.matrix = np.array([np.pad(v, (0, dim - v.size)) for v in self.vectors])
        self.ids, self.of = np.array([i for i, _ in self.keys]), np.array(self.labels)
        wide = max((len(w) for w in self.windows if w), default=0) if self.negatives else 1
        self.low, self.high = np.full((wide, n), _most), np.full((wide, n), _least)  # empty windows
        for a, w in enumerate(self.windows):
            for j, p in enumerate(w or []):  # the whole scores of a window
                self.low[j, a], self.high[j, a] = -(-LOW * p // 100), HIGH * p // 100 if p >= 0 else _least
        if not self.negatives:
            self.low[:], self.high[:] = _least, _most
        self.best: list[list[list[tuple]]] = [[[] for _ in range(n)] for _ in range(wide)]

    def see(self, part: pa.RecordBatch) -> None:
        column, labels = part.column("id"), np.asarray(part.column("label"))
        null = np.asarray(column.is_null())
        ids = np.asarray(column.fill_null(0))
        twins = np.asarray(part.column("twin"))
        scores = products(self.matrix, _matrix(part.column("v"), 0))
        same = self.of[:, None] == labels[None, :]
        meant = (~same if self.negatives else same) & (null[None, :] | (self.ids[:, None] != ids[None, :]))
        for best, low, high in zip(self.best, self.low, self.high):
            fit = meant & (scores >= low[:, None]) & (scores <= high[:, None])
            for a in np.flatnonzero(fit.any(axis=1)).tolist():
                at = np.flatnonzero(fit[a])
                if at.size > self.k:  # ties with the k-th stay, to be settled by id
                    s = scores[a, at]
                    at = at[s >= np.partition(s, -self.k)[-self.k]]
                new = zip((-scores[a, at]).tolist(), null[at].tolist(), ids[at].tolist(), twins[at].tolist())
                best[a] = sorted([*best[a], *new])[: self.k]
                if len(best[a]) == self.k:
                    low[a] = max(low[a], -best[a][-1][0])

    def found(self) -> pa.RecordBatch:
        rows = {(*self.keys[a], -m, None if null else i, x) for best in self.best for a, own in enumerate(best) for m, null, i, x in own}
        cols = list(zip(*rows)) or [()] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=_OUT)


def _cells(k: int, negatives: bool):
    """Of each cell's stream (its anchors first, then its rows): what the cell passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, closed = None, None, False
        for batch in batches:
            cells, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            changes = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            cuts = [0, *changes.tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    if closed:
                        yield block.found()
                    cell, block, closed = cells[lo], _Block(k, negatives), False
                for a in range(lo, hi, CHUNK):
                    part = batch.slice(a, min(CHUNK, hi - a))
                    if kinds[lo] == 0:
                        block.add(part)
                    elif block.keys:
                        if not closed:
                            block.close()
                            closed = True
                        block.see(part)
        if closed:
            yield block.found()

    return run


def _scored(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, k: int, negatives: bool) -> DataFrame:
    """(anchor, twin, score, id, other: the row's twin) of what each cell of the grid passes on."""
    part = lambda n: F.pmod(F.xxhash64("id", "label", "v"), F.lit(n))
    none = F.lit(None).cast("array<long>")
    each = lambda n, at: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))
    own = rows.select(F.lit(1).alias("kind"), "id", "label", "twin", "v", none.alias("windows"), each(blocks, lambda i: part(groups) * blocks + i).alias("cell"))
    of = anchors.select(F.lit(0).alias("kind"), "id", "label", "twin", "v", "windows", each(groups, lambda i: i * blocks + part(blocks)).alias("cell"))
    every = own.unionByName(of).repartition("cell").sortWithinPartitions("cell", "kind")
    return every.mapInArrow(_cells(k, negatives), "anchor long, twin long, score long, id long, other long")


def _stream(k: int):
    """Over rows in order of (anchor, twin, descending score, kind, id): the first k negatives of each positive's window."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, twin, score, kind, i in zip(*(batch.column(c).to_pylist() for c in ("anchor", "twin", "score", "kind", "id"))):
                if (anchor, twin) != now:
                    now, windows = (anchor, twin), []
                if kind == 0:
                    windows.append([score, i, 0])
                    continue
                for w in windows:
                    if w[2] < k and LOW * w[0] <= 100 * score <= HIGH * w[0]:
                        w[2] += 1
                        out.append((anchor, w[1], w[2], i, w[0], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, *, rows_in_group: int = ROWS, anchors_in_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for a table of labelled() rows."""
    rows = materialize(table.withColumn("twin", F.xxhash64("label", "v")), "vectors")  # tells rows of one id apart
    anchors = materialize(rows.filter(is_anchor & F.col("id").isNotNull()), "anchors")
    groups, blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), rows_in_group), (anchors.count(), anchors_in_block)))
    none = F.lit(None).cast("array<long>")
    found = _scored(rows, anchors.withColumn("windows", none), groups, blocks, positives, False)
    first = Window.partitionBy("anchor", "twin").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    best = found.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= positives)
    best = best.groupBy("anchor", "twin").agg(F.sort_array(F.collect_list(F.struct("__n", "score", "id"))).alias("p"))
    best = materialize(best, "positives")
    opened = anchors.join(best.withColumnRenamed("twin", "__t"), (F.col("id") == F.col("anchor")) & (F.col("twin") == F.col("__t")))
    opened = opened.withColumn("windows", F.transform("p", lambda x: x["score"])).drop("anchor", "__t", "p")
    offered = _scored(rows, opened, groups, blocks, negatives, True).select("anchor", "twin", "score", F.lit(1).alias("kind"), "id", "other")
    taken = best.select("anchor", "twin", F.explode("p").alias("p")).select("anchor", "twin", "p.score", F.lit(0).alias("kind"), "p.id", F.col("p.__n").cast("long").alias("other"))
    keyed = taken.unionByName(offered).repartition("anchor")
    keyed = keyed.sortWithinPartitions("anchor", "twin", F.desc("score"), "kind", F.asc_nulls_last("id"), "other")
    return keyed.mapInArrow(_stream(negatives), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

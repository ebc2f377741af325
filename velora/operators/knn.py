"""Exact nearest neighbours by blocks.

Queries and rows of a group (or all, for a stated query set) are dealt into units: so
many queries against so many rows, each a stream in which the queries come first. A
task holds a unit's queries and the k nearest so far, and meets the rows batch by
batch, so neither its memory nor what it gives out (k rows per query and unit) follows
the number of pairs. Units are bounded in both directions, whatever the sizes of groups.
Matrix products choose candidates with a margin for rounding; the distances given out
are exact row by row, so equal vectors tie exactly and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from velora.functions.vectors import pairwise, rowwise

#: Queries of one matrix product; it has four times as many rows.
BLOCK = 1024
#: Units that the work is cut into, about; fewest pairs of one; most queries of one, which meet four times as many rows.
UNITS, UNIT_PAIRS, UNIT_QUERIES = 100, 1 << 22, 1 << 15
_NONE = np.iinfo(np.int64).max


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def kind_of(df: DataFrame, vector: str) -> str:
    """Floats need no doubles before arithmetic."""
    return "array<float>" if isinstance(df.schema[vector].dataType.elementType, FloatType) else "array<double>"


class Nearest:
    """The k nearest rows met so far of each query, by (distance, id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str = "l2", skip_self: bool = False, block: int = BLOCK) -> None:
        self.ids, self.vectors, self.metric, self.skip_self, self.block = ids, vectors, metric, skip_self, block
        self.norms = (vectors * vectors).sum(1)
        self.dist, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), _NONE)

    def meet(self, b_ids: np.ndarray, b: np.ndarray) -> None:
        for s in range(0, len(b), 4 * self.block):
            ids, part = b_ids[s : s + 4 * self.block], b[s : s + 4 * self.block]
            norms = (part * part).sum(1)
            # one product gives squared distances
            wide = np.column_stack([part, norms, np.ones(len(part))]) if self.metric == "l2" else part
            for t in range(0, len(self.ids), self.block):
                self._pair(slice(t, t + self.block), ids, part, wide, norms.max())

    def _pair(self, some: slice, b_ids: np.ndarray, b: np.ndarray, wide: np.ndarray, most: float) -> None:
        q, kth = self.vectors[some], self.dist[some, -1]
        rough = np.column_stack([-2 * q, np.ones(len(q)), self.norms[some]]) @ wide.T if self.metric == "l2" else pairwise(q, b, self.metric)
        new = np.isinf(kth)
        if new.any():
            if self.skip_self:
                rough[self.ids[some][:, None] == b_ids[None, :]] = np.inf
            keep = min(self.dist.shape[1], len(b))
            kth = np.where(new, np.partition(rough, keep - 1, axis=1)[:, keep - 1], kth)
        limit = np.where(np.isfinite(kth), kth + 1e-9 * (1 + np.abs(kth) + self.norms[some] + most), np.finfo(float).max)
        row, col = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(b))
        if self.skip_self:
            other = self.ids[some][row] != b_ids[col]
            row, col = row[other], col[other]
        if not len(row):
            return
        exact = rowwise(q[row], b[col], self.metric)
        used, at = np.unique(row, return_inverse=True)
        k, used = self.dist.shape[1], used + some.start
        who = np.concatenate([np.repeat(np.arange(len(used)), k), at])
        dist, ids = np.concatenate([self.dist[used].ravel(), exact]), np.concatenate([self.near[used].ravel(), b_ids[col]])
        order = np.lexsort((ids, dist, who))
        who, dist, ids = who[order], dist[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < k
        self.dist[used[who[top]], rank[top]], self.near[used[who[top]], rank[top]] = dist[top], ids[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, distance), nearest first."""
        row, rank = np.nonzero(self.near != _NONE)
        return row, self.near[row, rank], self.dist[row, rank]


def units_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """grp, at, part, side, id, v: queries (side 0) and rows (grp, id, v) dealt into units (grp, at, part), each in one partition, queries first."""
    counts = left.groupBy("grp").agg(F.count("*").alias("n_left")).join(right.groupBy("grp").agg(F.count("*").alias("n_right")), "grp")
    total = counts.agg(F.sum(F.col("n_left").cast("double") * F.col("n_right"))).first()[0] or 0.0
    wide = int(min(UNIT_QUERIES, max(1.0, (max(UNIT_PAIRS, total / UNITS) / 4) ** 0.5)))
    cut = counts.select("grp", F.ceil(F.col("n_left") / wide).alias("p"), F.ceil(F.col("n_right") / (4 * wide)).alias("r"), "n_left", "n_right")
    units, moved = cut.agg(F.sum(F.col("p") * F.col("r")), F.sum(F.col("n_left") * F.col("r") + F.col("n_right") * F.col("p"))).first()
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = left.join(F.broadcast(cut), "grp").select("grp", own("p").alias("at"), every("r").alias("part"), F.lit(0).alias("side"), "id", "v")
    met = right.join(F.broadcast(cut), "grp").select("grp", every("p").alias("at"), own("r").alias("part"), F.lit(1).alias("side"), "id", "v")
    key = ["grp", "at", "part"]
    return asked.unionByName(met).repartition(max(1, min(4 * (units or 0), 4 * UNITS), (moved or 0) >> 18), *key).sortWithinPartitions(*key, "side")


def block_topk(queries: DataFrame, base: DataFrame, k: int, *, group: str | None = None, metric: str = "l2", skip_self: bool = True, query_id: str = "vec_id", base_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """grp, query_id, rank (from 1), neighbor_id, distance: the k nearest of each query, in its group if there is one. Rows with a null id or vector are left out."""
    kind = max((kind_of(df, vector) for df in (queries, base)), key=("array<float>", "array<double>").index)

    def rows(df: DataFrame, id_col: str) -> DataFrame:
        return df.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where("id is not null and v is not null")

    left, right = rows(queries, query_id), rows(base, base_id)
    dealt, block = units_of(left, right), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(grp: int, near: Nearest) -> pa.RecordBatch:
            row, ids, distance = near.found()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), grp)), pa.array(near.ids[row]), pa.array(ids), pa.array(distance)], ["grp", "query_id", "neighbor_id", "distance"])

        unit, held, near = None, [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in range(4)])
            ids, x = batch.column(4).to_numpy(), matrix(batch.column(5))
            edges = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)]):
                if a == b:
                    continue
                if unit != (now := tuple(names[:3, a].tolist())):
                    if near:
                        yield out(unit[0], near)
                    unit, held, near = now, [], None
                if not names[3, a]:
                    held.append((ids[a:b], x[a:b]))
                elif near or held:
                    near = near or Nearest(*map(np.concatenate, zip(*held)), k, metric, skip_self, block)
                    near.meet(ids[a:b], x[a:b])
        if near:
            yield out(unit[0], near)

    found = dealt.mapInArrow(run, "grp long, query_id long, neighbor_id long, distance double")
    best = Window.partitionBy("grp", "query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("grp", "query_id", "rank", "neighbor_id", "distance")


def exact_knn(queries: DataFrame, base: DataFrame, k: int, *, metric: str = "l2", skip_self: bool = True, query_id: str = "vec_id", base_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, neighbor_id, distance of a stated query set against all rows."""
    return block_topk(queries, base, k, metric=metric, skip_self=skip_self, query_id=query_id, base_id=base_id, vector=vector).drop("grp")


def knn_graph(vectors: DataFrame, degree: int, *, group: str | None = None, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """grp, src, pos, dst: each row's nearest rows of its group (of all rows without one)."""
    found = block_topk(vectors, vectors, degree, group=group, metric=metric, query_id=id_col, base_id=id_col, vector=vector)
    return found.select("grp", F.col("query_id").alias("src"), F.col("rank").alias("pos"), F.col("neighbor_id").alias("dst"))


def merge_topk(results: DataFrame, k: int) -> DataFrame:
    """Results of several shards (query_id, neighbor_id, distance) made one: a neighbour once, the k nearest."""
    once = results.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")

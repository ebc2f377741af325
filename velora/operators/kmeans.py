"""k-means: assignment, Lloyd steps, initial centres and whole fits. Centres are (center_id, center); they are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.ranking import md5_key
from velora.functions.vectors import pairwise, rowwise
from velora.operators.knn import block_topk
from velora.sources.shared import materialise, release

#: Most bytes of centres that are handed to every task; vectors meet more centres in the block join.
CENTER_BYTES = 64 << 20


def _center_bytes(centers: DataFrame) -> int:
    return centers.agg(F.sum(8 * F.size("center"))).first()[0] or 0


def center_arrays(centers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in id order, of centres that a task can hold."""
    rows = centers.select("center_id", F.col("center").cast("array<double>")).orderBy("center_id").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def parts_of(rows: int, centers: int) -> list[slice]:
    """The rows of a batch in slices whose distances to all centres take some 32 MB."""
    step = max(1, (4 << 20) // max(centers, 1))
    return [slice(k, k + step) for k in range(0, rows, step)]


def nearest_of(x: np.ndarray, ids: np.ndarray, points: np.ndarray, count: int, shut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, centre's place, rank and distance of each row's nearest centres but for those that are shut to it.

    A matrix product chooses candidates with a margin for its rounding; ranks are by
    exact distance, then by id.
    """
    rough = pairwise(x, points)
    if shut is not None:
        rough[shut] = np.inf
    kth = np.partition(rough, count - 1, axis=1)[:, count - 1]
    row, col = np.nonzero((rough <= (kth + 1e-9 * (1 + kth + (x * x).sum(1)))[:, None]) & np.isfinite(rough))
    exact = rowwise(x[row], points[col])
    order = np.lexsort((ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    top = rank <= count
    return row[top], col[top], rank[top].astype(np.int32), exact[top]


def nearest_centers(vectors: DataFrame, centers: DataFrame, count: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, center_id, rank, dist: the nearest centres of each vector; equal distances by center_id.

    A scan without a shuffle; more than CENTER_BYTES of centres are met block by
    block. Vectors that are null have no row.
    """
    if _center_bytes(centers) > CENTER_BYTES:
        asked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        found = block_topk(asked, centers.select("center_id", F.col("center").alias("v")), count, skip_self=False, query_id="vec_id", base_id="center_id", vector="v")
        return found.select(F.col("query_id").alias("vec_id"), F.col("neighbor_id").alias("center_id"), F.col("rank").cast("int").alias("rank"), F.col("distance").alias("dist"))
    ids, points = center_arrays(centers)
    count = min(count, len(ids))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame) or not count:
                continue
            x = np.stack(frame["v"].to_numpy()).astype(np.float64)
            for some in parts_of(len(x), len(ids)):
                row, col, rank, dist = nearest_of(x[some], ids, points, count)
                yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[some][row], "center_id": ids[col], "rank": rank, "dist": dist})

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(run, "vec_id long, center_id long, rank int, dist double")


def kmeans_assign(vectors: DataFrame, centers: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, center_id, dist of the nearest centre."""
    return nearest_centers(vectors, centers, 1, id_col, vector).select("vec_id", "center_id", "dist")


def group_means(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """center_id, center: the mean vector of each group, dimension by dimension with partial sums."""
    long = rows.select(F.col(group).cast("long").alias("center_id"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    means = long.groupBy("center_id", "dim").agg(F.avg("x").alias("x"))
    return means.groupBy("center_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("center"))


def center_sums(vectors: DataFrame, ids: np.ndarray, points: np.ndarray, vector: str = "embedding") -> DataFrame:
    """center_id, n, sums, residual: partial results of the batches, one row for each centre that a batch has vectors of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["v"].to_numpy()).astype(np.float64)
            rough = pairwise(x, points)
            least = rough.min(1)
            row, col = np.nonzero(rough <= (least + 1e-9 * (1 + least))[:, None])
            exact = rowwise(x[row], points[col])
            order = np.lexsort((ids[col], exact, row))
            first = np.append(True, np.diff(row[order]) != 0)
            near, dist = col[order][first], exact[order][first]
            used, group = np.unique(near, return_inverse=True)
            sums = np.zeros((len(used), x.shape[1]))
            np.add.at(sums, group, x)
            yield pd.DataFrame({"center_id": ids[used], "n": np.bincount(group), "sums": list(sums), "residual": np.bincount(group, dist)})

    return vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInPandas(run, "center_id long, n long, sums array<double>, residual double")


def _stepped(vectors: DataFrame, centers: DataFrame, empty: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(new centres, center_id and residual of the old ones) of centres that tasks hold; vectors are read once."""
    partial = materialise(center_sums(vectors, *center_arrays(centers), vector), "center-sums")
    totals = partial.groupBy("center_id").agg(F.sum("n").alias("n"))
    means = partial.select("center_id", F.posexplode("sums").alias("dim", "x")).groupBy("center_id", "dim").agg(F.sum("x").alias("x"))
    means = means.groupBy("center_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("sums"))
    means = means.join(totals, "center_id").select("center_id", F.transform("sums", lambda x: x / F.col("n")).alias("mean"))
    return _or_old(centers, means, empty), partial.groupBy("center_id").agg(F.sum("residual").alias("residual"))


def _or_old(centers: DataFrame, means: DataFrame, empty: str) -> DataFrame:
    old = F.col("center").cast("array<double>")
    return centers.join(means, "center_id", "left").select("center_id", F.coalesce("mean", old if empty == "keep" else F.transform(old, lambda x: F.lit(0.0))).alias("center"))


def lloyd_step(vectors: DataFrame, centers: DataFrame, *, empty: str = "keep", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """New centres. A centre without vectors stays (empty="keep") or becomes zero (empty="zero").

    Vectors are summed by centre where they are read, so only sums are shuffled. More
    than CENTER_BYTES of centres take the assignment as a table.
    """
    if _center_bytes(centers) <= CENTER_BYTES:
        return _stepped(vectors, centers, empty, vector)[0]
    assigned = kmeans_assign(vectors, centers, id_col, vector)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).join(assigned, "vec_id")
    return _or_old(centers, group_means(rows, "center_id", "v").withColumnRenamed("center", "mean"), empty)


def uniform_centers(vectors: DataFrame, k: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """center_id, center: k distinct rows, each set of k equally likely: the first by the seeded digest of the id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("center")).where("center is not null")
    first = rows.orderBy(md5_key(seed, "vec_id"), "vec_id").limit(k)
    return first.select((F.row_number().over(Window.orderBy(md5_key(seed, "vec_id"), "vec_id")) - 1).cast("long").alias("center_id"), "center")


def residual(vectors: DataFrame, centers: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: residual, the sum of squared distances to the nearest centres."""
    return kmeans_assign(vectors, centers, id_col, vector).agg(F.sum("dist").alias("residual"))


def kmeans_pp_init(vectors: DataFrame, k: int, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k-means++ on a bounded sample: each next centre is drawn with probability in proportion to its distance.

    The draw is the exponential race: the row with the largest log(u) / dist, u
    uniform from the seeded digest of (seed, draw, id), so it needs no order and
    one aggregation per draw. Already chosen rows have distance zero and can't win.
    The least distance so far stays with each row, so a draw looks at the newest
    centre only; it is written every few draws, so that lineage and the number of
    centres that a task computes stay small.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.lit(float("inf")).alias("dist")).where("v is not null"), "kmeans-rows")
    first = rows.orderBy(md5_key(seed, F.lit(0), "vec_id"), "vec_id").limit(1).collect()
    chosen = [np.array(r.v) for r in first]
    seen = 0

    def least(frame: DataFrame, points: list[np.ndarray]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x, dist = np.stack(f["v"].to_numpy()), f["dist"].to_numpy()
                    for p in points:
                        dist = np.minimum(dist, ((x - p) ** 2).sum(1))
                    f["dist"] = dist
                    yield f

        return frame.mapInPandas(run, "vec_id long, v array<double>, dist double")

    while chosen and len(chosen) < k:
        near = least(rows, chosen[seen:])
        if len(chosen) - seen >= 8:
            near, old = materialise(near, "kmeans-rows"), rows
            release(old)
            rows, seen = near, len(chosen)
        u = (F.conv(F.substring(md5_key(seed, F.lit(len(chosen)), "vec_id"), 1, 13), 16, 10).cast("double") + 1) / float(16**13 + 1)
        pick = near.where("dist > 0").select(F.max_by(F.struct("vec_id", "v"), F.log(u) / F.col("dist")).alias("m")).first().m
        if pick is None:
            break
        chosen.append(np.array(pick.v))
    release(rows)
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(chosen)], "center_id long, center array<double>")


def kmeans_pp_pick(weights: DataFrame, u: float) -> DataFrame:
    """The row of (vec_id, dist) where the running sum of dist in id order first reaches u times the total.

    Running sums go by ranges of ids, whose totals are aggregated first.
    """
    low, high, total = weights.agg(F.min("vec_id"), F.max("vec_id"), F.sum("dist")).first()
    width = max(1, (high - low) // 64 + 1)
    cut = weights.withColumn("piece", F.floor((F.col("vec_id") - low) / width))
    sums = cut.groupBy("piece").agg(F.sum("dist").alias("s")).orderBy("piece").collect()
    aim, before = u * total, 0.0
    for row in sums:
        if before + row.s >= aim:
            break
        before += row.s
    running = F.sum("dist").over(Window.orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    inside = cut.where(F.col("piece") == row.piece).withColumn("running", running)
    return inside.where(F.col("running") >= aim).orderBy("vec_id").limit(1).select("vec_id", "running")


def kmeans_fit(vectors: DataFrame, k: int, *, max_iter: int = 15, tol: float = 1e-5, seed: int = 42, empty: str = "keep", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k-means++ and Lloyd until the residual improves by less than tol of itself, or max_iter steps."""
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")), "kmeans-fit")
    centers = kmeans_pp_init(rows, k, seed, "vec_id", "v")
    last = np.inf
    for _ in range(max_iter):
        # one pass gives the residual of these centres and the next ones
        following, spent = _stepped(rows, centers, empty, "v")
        now = spent.agg(F.sum("residual")).first()[0] or 0.0
        if now < np.finfo(np.float32).eps or (np.isfinite(last) and last - now < tol * last):
            break
        last = now
        ids, points = center_arrays(following)
        centers = vectors.sparkSession.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points)], "center_id long, center array<double>")
    release(rows)
    return centers

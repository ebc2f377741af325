"""Partitioning vectors into shards: by range, by nearest centres, and with capacities.

An assignment has the columns shard_id, vec_id, round, dist. With capacities the
rule is first come, first served in id order; _in_turn() gives its exact outcome by
a few parallel scans, and what the scans write are choices. Only where centres are more
than a task holds is every vector's list of all centres written. Ranks inside a shard are taken range by range (see
functions.ranking), so no task holds a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.ranking import PIECES, grouped_rank
from velora.functions.vectors import pairwise, rowwise
from velora.operators.kmeans import CENTER_BYTES, _center_bytes, center_arrays, nearest_centers, nearest_of, parts_of
from velora.sources.shared import materialise, release

#: The share of a shard that the first round fills, fixed by the method.
FIRST_ROUND = 0.8
#: Ids and distances of a point's centres, nearest first, and which are shut: the places that it takes.
Pick = Callable[[np.ndarray, np.ndarray, np.ndarray], list[int]]
_CHOICE = ["center_id", "vec_id", "round", "dist"]


def smoothed_share(share: float, block: int, new: int, rows: int) -> float:
    """A shard's share of the first round after a block (from 0) in which it got new of the rows; 1/k was before all."""
    return (share * (block + 1) + new / max(rows, 1)) / (block + 2)


def partition_range(vectors: DataFrame, shard_size: int, id_col: str = "vec_id") -> DataFrame:
    """shard_id, local_id, vec_id: contiguous ranges of shard_size ids."""
    i = F.col(id_col).cast("long")
    return vectors.select(F.floor(i / shard_size).cast("int").alias("shard_id"), (i % shard_size).alias("local_id"), i.alias("vec_id"))


def partition_even(vectors: DataFrame, parts: int, id_col: str = "vec_id") -> DataFrame:
    """shard_id, local_id, vec_id: parts ranges of n // parts ids; the last takes what is left."""
    size = max(1, vectors.count() // parts)
    i = F.col(id_col).cast("long")
    shard = F.least(F.floor(i / size), F.lit(parts - 1)).cast("int")
    return vectors.select(shard.alias("shard_id"), (i - shard.cast("long") * size).alias("local_id"), i.alias("vec_id"))


def partition_knearest(vectors: DataFrame, centers: DataFrame, copies: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector in the shards of its nearest centres, without capacities; round is the centre's rank."""
    near = nearest_centers(vectors, centers, copies, id_col, vector)
    return near.select(F.col("center_id").cast("int").alias("shard_id"), "vec_id", F.col("rank").alias("round"), "dist")


def _in_turn(source: DataFrame, centers: DataFrame, caps: dict[int, int], pick: Pick, quota: int | None, name: str) -> DataFrame:
    """center_id, vec_id, round, dist: what points choose one after the other in id order, in parallel.

    All that a point needs to know of earlier ones is which shards are full, that is
    the id of the last point that each shard had a seat for. These ids are guessed (at
    first no shard fills), all points choose, and the ids that follow from their choices
    are the next guess, until they are those guessed. By induction over the ids just one
    set of them agrees with its own choices, the sequential one. Where guess and outcome
    first differ, the outcome is right; if a guess proves too strict, only the part known
    to be right is taken over, so two scans find one more full shard at the latest.

    The source has vec_id and a vector v, which chooses among all centres, or vec_id and
    the ids and dists of its candidates, nearest first. pick(ids, dists, shut) gives the
    places chosen from those. With a quota, vectors for which enough centres are open take
    the nearest of them. The id that fills a shard is looked for in the one range of ids
    that holds it, after ranges were counted.
    """
    spark, never = source.sparkSession, np.iinfo(np.int64).max
    seats = F.broadcast(spark.createDataFrame([(int(c), int(n)) for c, n in caps.items()], "center_id long, cap long"))
    ids, points = np.array(sorted(caps), np.int64), np.empty((0, 0))
    if packed := "v" in source.columns and _center_bytes(centers) <= CENTER_BYTES:
        ids, points = center_arrays(centers)
    elif "v" in source.columns:
        source = materialise(_lists(nearest_centers(source, centers, len(caps), "vec_id", "v")), "center-lists")
    count = min(quota or 0, len(ids))
    edges = np.unique(np.array(source.agg(F.percentile_approx("vec_id", [k / PIECES for k in range(1, PIECES)], 20 * PIECES)).first()[0] or [], np.int64))

    def choices(last: np.ndarray):
        closed = dict(zip(ids.tolist(), last.tolist()))

        def placed(found: pd.DataFrame) -> pd.DataFrame:
            return found.assign(piece=np.searchsorted(edges, found["vec_id"].to_numpy(np.int64), side="right"))

        def one(vec_id: int, own: np.ndarray, dists: np.ndarray) -> list[tuple]:
            shut = np.array([vec_id > closed[c] for c in own.tolist()], bool)
            return [(own[c], vec_id, k + 1, dists[c]) for k, c in enumerate(pick(own, dists, shut))]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame) or not len(ids):
                    continue
                names = frame["vec_id"].to_numpy()
                if not packed:
                    yield placed(pd.DataFrame([t for r in zip(names, frame["ids"], frame["dists"]) for t in one(*r)], columns=_CHOICE))
                    continue
                x = np.stack(frame["v"].to_numpy()).astype(np.float64)
                for some in parts_of(len(x), len(ids)):
                    part, own = x[some], names[some]
                    left = np.arange(len(part))
                    if count:
                        row, col, rank, dist = nearest_of(part, ids, points, count, own[:, None] > last[None, :])
                        left = np.flatnonzero(np.bincount(row, minlength=len(part)) < quota)
                        whole = ~np.isin(row, left)
                        yield placed(pd.DataFrame({"center_id": ids[col[whole]], "vec_id": own[row[whole]], "round": rank[whole], "dist": dist[whole]}))
                    found = []
                    for r in left:
                        dists = rowwise(part[r][None, :], points)
                        order = np.lexsort((ids, dists))
                        found += one(own[r], ids[order], dists[order])
                    yield placed(pd.DataFrame(found, columns=_CHOICE))

        return run

    always = {c: np.iinfo(np.int64).min for c, n in caps.items() if n <= 0}
    guess = dict(always)
    piece = Window.partitionBy("center_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        taken = materialise(source.mapInPandas(choices(np.array([guess.get(c, never) for c in ids.tolist()], np.int64)), "center_id long, vec_id long, round int, dist double, piece int"), name)
        sizes = taken.groupBy("center_id", "piece").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(piece), "size": F.sum("n").over(Window.partitionBy("center_id"))})
        last = sizes.join(seats, "center_id").where("cap > 0 and upto >= cap and upto - n < cap").select("center_id", "piece", (F.col("cap") - F.col("upto") + F.col("n")).cast("int").alias("place"), (F.col("size") > F.col("cap")).alias("more")).collect()
        full = [(r.center_id, r.piece, r.place) for r in last if r.more or r.center_id in guess]
        found = dict(always)
        if full:
            own = taken.join(F.broadcast(spark.createDataFrame(full, "center_id long, piece int, place int")), ["center_id", "piece"])
            ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("center_id").orderBy("vec_id")))
            found |= {r[0]: r[1] for r in ranked.where("n = place").select("center_id", "vec_id").collect()}
        if found == guess:
            return taken.drop("piece")
        differ = min(min(guess.get(c, never), found.get(c, never)) for c in guess.keys() | found.keys() if guess.get(c) != found.get(c))
        strict = any(found.get(c, never) > at for c, at in guess.items())
        guess = {c: at for c, at in found.items() if at <= differ} if strict else found
        release(taken)


def _lists(found: DataFrame) -> DataFrame:
    """vec_id, ids, dists: each vector's candidates of (vec_id, center_id, dist), nearest first."""
    own = found.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("dist", "center_id"))).alias("c"))
    return own.select("vec_id", F.col("c.center_id").alias("ids"), F.col("c.dist").alias("dists"))


def _rows(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")


def _first_open(ids: np.ndarray, dists: np.ndarray, shut: np.ndarray) -> list[int]:
    return np.flatnonzero(~shut)[:1].tolist()


def _border(first: DataFrame, rows: DataFrame, centers: DataFrame, epsilon: float, bounds: dict[int, float]) -> DataFrame:
    """vec_id, center_id, dist: centres besides a vector's own at less than epsilon times its distance and less than their bound."""
    own = rows.join(first.select("vec_id", F.col("center_id").alias("own"), F.col("dist").alias("d1")), "vec_id")
    if _center_bytes(centers) > CENTER_BYTES:
        limits = F.broadcast(rows.sparkSession.createDataFrame(list(bounds.items()), "center_id long, bound double"))
        near = nearest_centers(rows, centers, len(bounds), "vec_id", "v").join(own.drop("v"), "vec_id").join(limits, "center_id")
        return near.where((F.col("center_id") != F.col("own")) & (F.col("dist") < epsilon * F.col("d1")) & (F.col("dist") < F.col("bound"))).select("vec_id", "center_id", "dist")
    ids, points = center_arrays(centers)
    bound = np.array([bounds[c] for c in ids.tolist()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x, names, mine, d1 = np.stack(frame["v"].to_numpy()), frame["vec_id"].to_numpy(), frame["own"].to_numpy(), frame["d1"].to_numpy()
            for some in parts_of(len(x), len(ids)):
                part, most = x[some], np.minimum(epsilon * d1[some][:, None], bound[None, :])
                row, col = np.nonzero(pairwise(part, points) <= most + 1e-9 * (1 + most + (part * part).sum(1)[:, None]))
                dist = rowwise(part[row], points[col])
                near = (ids[col] != mine[some][row]) & (dist < most[row, col])
                yield pd.DataFrame({"vec_id": names[some][row[near]], "center_id": ids[col[near]], "dist": dist[near]})

    return own.mapInPandas(run, "vec_id long, center_id long, dist double")


def partition_selective(vectors: DataFrame, centers: DataFrame, copies: int, limit: int, epsilon: float, id_col: str = "vec_id", vector: str = "embedding", *, block_rows: int | None = None) -> DataFrame:
    """Two rounds with capacities; only vectors near a border are in more than one shard.

    Round 1: each vector goes to its nearest centre with a seat; seats are
    floor(0.8 * limit) + 1. Round 2: up to copies - 1 more centres at less than
    epsilon times the first distance and less than 2 * epsilon times the shard's
    radius (the largest first-round distance); seats are limit - taken + 1. A
    vector for which round 1 has no seat goes to its nearest centre as round 0.
    Ids are distinct; vectors that are null have no row.

    With block_rows, ranges of so many ids (from 0) go through both rounds one after
    the other. Counts and radii carry over. Before the last block, a shard's seats in
    round 2 follow from the smoothed share of round 1 that it is expected to get, and
    the radius counts 1 + 1/b times in the b-th block instead of twice.
    """
    rows, spark = _rows(vectors, id_col, vector), vectors.sparkSession
    shards = [r[0] for r in centers.select(F.col("center_id").cast("long")).collect()]
    n = rows.count() if block_rows else 0
    blocks = max(1, -(-n // block_rows)) if block_rows else 1
    most_first = int(FIRST_ROUND * limit)
    firsts, seconds, radius, share = (dict.fromkeys(shards, x) for x in (0, 0, 0.0, 1 / max(len(shards), 1)))
    out = None
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where((F.col("vec_id") >= b * block_rows) & ((F.col("vec_id") < (b + 1) * block_rows) | F.lit(b == blocks - 1)))
        open_seats = {c: min(most_first + 1 - firsts[c], limit + 1 - firsts[c] - seconds[c]) for c in shards}
        first = _in_turn(block, centers, open_seats, _first_open, 1, "first-round")
        got = {r[0]: r[1:] for r in first.groupBy("center_id").agg(F.count("*"), F.max("dist")).collect()}
        size = sum(k for k, _ in got.values()) if blocks == 1 else block.count()
        for c in shards:
            new, far = got.get(c, (0, 0.0))
            firsts[c], radius[c] = firsts[c] + new, max(radius[c], far)
            share[c] = smoothed_share(share[c], b, new, size)
        second_seats = {c: (limit - firsts[c] if b == blocks - 1 else max(limit - int(share[c] * n), limit - most_first)) + 1 - seconds[c] for c in shards}
        second_seats = {c: max(0, min(k, limit + 1 - firsts[c] - seconds[c])) for c, k in second_seats.items()}
        found = first.select("center_id", "vec_id", "round", "dist")
        if copies > 1:
            wanted = _border(first, block, centers, epsilon, {c: epsilon * (1 + 1 / (b + 1)) * r for c, r in radius.items()})
            lists = materialise(_lists(wanted), "border-lists")
            second = _in_turn(lists, centers, second_seats, lambda ids, dists, shut: np.flatnonzero(~shut)[: copies - 1].tolist(), None, "second-round")
            release(lists)
            for c, k in second.groupBy("center_id").count().collect() if blocks > 1 else ():
                seconds[c] += k
            found = found.unionByName(second.select("center_id", "vec_id", F.lit(2).alias("round"), "dist"))
        out = found if out is None else out.unionByName(found)
        left = block.join(first.select("vec_id"), "vec_id", "left_anti")
        out = out.unionByName(nearest_centers(left, centers, 1, "vec_id", "v").select("center_id", "vec_id", F.lit(0).alias("round"), "dist"))
    return out.select(F.col("center_id").cast("int").alias("shard_id"), "vec_id", "round", "dist")


def partition_nonselective(vectors: DataFrame, centers: DataFrame, copies: int, limit: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exactly copies shards for every vector.

    In id order, nearest first; a full shard (limit vectors) is passed over, but
    not where the centres left are only just enough.
    """

    def pick(ids: np.ndarray, dists: np.ndarray, shut: np.ndarray) -> list[int]:
        out: list[int] = []
        for c in range(len(ids)):
            need = copies - len(out)
            if need and (not shut[c] or len(ids) - c <= need):
                out.append(c)
        return out

    return _shards(vectors, centers, limit, pick, copies, id_col, vector)


def _shards(vectors: DataFrame, centers: DataFrame, limit: int, pick: Pick, quota: int | None, id_col: str, vector: str) -> DataFrame:
    caps = {r[0]: limit for r in centers.select(F.col("center_id").cast("long")).collect()}
    return _in_turn(_rows(vectors, id_col, vector), centers, caps, pick, quota, "shards-in-turn").select(F.col("center_id").cast("int").alias("shard_id"), "vec_id", "round", "dist")


def overlap_choice(dists: np.ndarray, shut: np.ndarray, epsilon: float, copies: int) -> list[int]:
    """The centres whose distance is at most epsilon times the mean of those that passed so far.

    The first always passes. A full shard's distance counts in the mean, but the
    mean starts anew after it.
    """
    out: list[int] = []
    total, passed, mean = 0.0, 0, np.inf
    for c in range(len(dists)):
        if len(out) == copies:
            break
        if dists[c] > epsilon * mean:
            continue
        total, passed = total + dists[c], passed + 1
        mean = total / passed
        if shut[c]:
            mean = np.inf
        else:
            out.append(c)
    return out


def partition_overlap(vectors: DataFrame, centers: DataFrame, copies: int, limit: int, epsilon: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Shards by the running-average overlap rule, with at most limit vectors each, in id order."""
    return _shards(vectors, centers, limit, lambda ids, dists, shut: overlap_choice(dists, shut, epsilon, copies), None, id_col, vector)


def local_ids(assignment: DataFrame) -> DataFrame:
    """The assignment with local_id, the position (from 0) in its shard in id order."""
    ranked = grouped_rank(assignment, ["shard_id"], "vec_id", "local_id")
    return ranked.withColumn("local_id", (F.col("local_id") - 1).cast("long"))


def shard_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("shard_id").agg(F.count("*").alias("n"))


def replication_factor(assignment: DataFrame) -> DataFrame:
    """One row: n_rows, n_vectors, replication."""
    per = assignment.groupBy("vec_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_vectors")).withColumn("replication", F.col("n_rows") / F.col("n_vectors"))


def shard_radius(assignment: DataFrame) -> DataFrame:
    """The largest first-round distance of each shard."""
    return assignment.where("round = 1").groupBy("shard_id").agg(F.max("dist").alias("radius"))


def unassigned(vectors: DataFrame, assignment: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Vectors in no shard."""
    return vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(assignment.select("vec_id"), "vec_id", "left_anti")


def estimate_cluster_sizes(sample: DataFrame, centers: DataFrame, copies: int, rate: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """shard_id, estimate: rows of each shard, scaled up from a sample."""
    found = partition_knearest(sample, centers, copies, id_col, vector)
    return found.groupBy("shard_id").agg((F.count("*") / rate).alias("estimate"))


def partition_by_budget(vectors: DataFrame, budget_gb: float, degree: int, copies: int, *, epsilon: float = 2.0, block_rows: int | None = None, rate: float = 0.05, min_parts: int = 1, max_iter: int = 15, element_bytes: int = 4, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame | None]:
    """Plan, sample, train and assign: (assignment, centers). One partition passes everything through."""
    from velora.functions.planning import plan_partitions, sampling_rate
    from velora.operators.kmeans import kmeans_fit
    from velora.operators.sampling import bernoulli_sample

    n, dim = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    parts, limit = plan_partitions(n, dim or 0, degree, budget_gb, copies, element_bytes)
    parts = max(parts, min_parts)
    if parts == 1:
        return vectors.select(F.lit(0).alias("shard_id"), F.col(id_col).cast("long").alias("vec_id"), F.lit(1).alias("round"), F.lit(0.0).alias("dist")), None
    sample = bernoulli_sample(vectors, max(sampling_rate(n, rate), min(1.0, 10 * parts / n)), seed, id_col)
    centers = kmeans_fit(sample, parts, max_iter=max_iter, seed=seed, id_col=id_col, vector=vector)
    return partition_selective(vectors, centers, copies, limit, epsilon, id_col, vector, block_rows=block_rows), centers


def partition_by_ram(vectors: DataFrame, budget_gb: float, degree: int, copies: int, *, start: int = 3, element_bytes: int = 4, seed: int = 42, max_sample: int = 256_000, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Raise the number of shards by two until the largest, estimated on a test sample, fits the budget."""
    from velora.functions.planning import GB, SLACK, estimate_memory
    from velora.operators.kmeans import kmeans_fit
    from velora.operators.sampling import bernoulli_sample

    n, dim = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    rate = min(1.0, max_sample / max(n, 1))
    train, test = (materialise(bernoulli_sample(vectors, rate, f"{seed}-{x}", id_col), f"{x}-sample") for x in ("train", "test"))
    parts = start
    while True:
        centers = kmeans_fit(train, parts, seed=seed, id_col=id_col, vector=vector)
        largest = estimate_cluster_sizes(test, centers, copies, rate, id_col, vector).agg(F.max("estimate")).first()[0] or 0
        if SLACK * estimate_memory(int(largest), dim or 0, degree, element_bytes) <= budget_gb * GB or parts >= n:
            return partition_knearest(vectors, centers, copies, id_col, vector), centers
        parts += 2

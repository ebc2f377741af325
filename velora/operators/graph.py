"""Approximate and hierarchical neighbour graphs; exact ones are in knn."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.planning import LayerPlan, layer_plan
from velora.functions.ranking import grouped_rank, md5_key
from velora.functions.vectors import l2_squared
from velora.operators.knn import kind_of, knn_graph, matrix
from velora.operators.sampling import shuffle_rows, uniform
from velora.sources.shared import materialise, release


def nn_descent(vectors: DataFrame, degree: int, *, rounds: int = 6, seed: int = 42, group: str | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """src, pos, dst: an approximate k-nearest-neighbour graph by neighbours of neighbours.

    Each round joins every node's neighbours, forward and backward (at most degree
    backward ones by the seeded digest), with their own, where they meet (_through()), and
    keeps the degree nearest. Rounds end early when no list changes. With a group column, only
    rows of one group become neighbours.
    """
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    v = materialise(vectors.select(g.alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind_of(vectors, vector)).alias("v")).where("id is not null and v is not null"), "descent-rows")
    best = Window.partitionBy("grp", "src").orderBy("dist", "dst")
    # the first lists: random rows of the group, by their places in id order
    placed = materialise(grouped_rank(v.select("grp", "id"), ["grp"], "id", "place"), "descent-places")
    n = placed.groupBy("grp").agg(F.count("*").alias("n"))
    drawn = placed.join(n, "grp").select("grp", F.col("id").alias("src"), "n", F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("k"))
    drawn = drawn.select("grp", "src", (F.floor(uniform(seed, "src", "k") * F.col("n")) + 1).cast("long").alias("place"))
    pairs = drawn.join(placed.select("grp", F.col("id").alias("dst"), "place"), ["grp", "place"]).where("src <> dst").select("grp", "src", "dst").distinct()

    s, t = (v.select("grp", F.col("id").alias(c), F.col("v").alias(f"v_{c}")) for c in ("src", "dst"))
    lists = materialise(pairs.join(s, ["grp", "src"]).join(t, ["grp", "dst"]).select("grp", "src", "dst", l2_squared("v_src", "v_dst").alias("dist")), "descent-lists")
    for r in range(rounds):
        back = Window.partitionBy("grp", "src").orderBy(md5_key(seed + r, "src", "dst"))
        backward = lists.select("grp", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist").withColumn("n", F.row_number().over(back)).where(F.col("n") <= degree).drop("n")
        both = materialise(lists.unionByName(backward).distinct(), "descent-both")
        # a new edge needs a place among its row's nearest
        full = lists.groupBy("grp", F.col("src").alias("id")).agg(F.count("*").alias("n"), F.max("dist").alias("far")).select("grp", "id", F.when(F.col("n") >= degree, F.col("far")).otherwise(float("inf")).alias("far"))
        named = v.join(full, ["grp", "id"], "left").select("grp", "id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        new = _through(both, named, degree).unionByName(both)
        merged = lists.unionByName(new).repartition("grp", "src").distinct()
        better = materialise(merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= degree).drop("n"), "descent-lists")
        changed = better.join(lists.select("grp", "src", "dst"), ["grp", "src", "dst"], "left_anti").count()
        lists, *old = better, lists, both
        release(*old)
        if not changed:
            break
    return lists.withColumn("pos", F.row_number().over(best)).select("src", "pos", "dst")


#: Pairs of rows whose distances are computed at once.
PAIRS = 1 << 15


def _through(both: DataFrame, named: DataFrame, degree: int) -> DataFrame:
    """grp, src, dst, dist: edges over two others, by the row between, that may be among their row's degree nearest.

    A vector goes once to each row that it has an edge from or to, not to each pair. Of what
    a row leads to, the degree nearest of a source are given out, if they aren't further
    than its list reaches (far): no other can enter the list. Rows that many edges lead
    to are met in streams, after the few that they lead to. Elements are summed left to right.
    """
    ends = both.select("grp", F.col("src").alias("mid"), F.col("dst").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(both.select("grp", F.col("dst").alias("mid"), F.col("src").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    ends = ends.groupBy("grp", "mid", "id").agg(F.max("out").cast("long").alias("out"), F.max("in").cast("long").alias("in"))
    met = ends.join(named, ["grp", "id"]).select("grp", "mid", "out", "in", "id", "far", "v").repartition("grp", "mid").sortWithinPartitions("grp", "mid", F.desc("out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the row that the last batch ended with and what it leads to
        last, held_x, held = None, None, np.empty(0, np.int64)
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
                batch, rest = batch.to_batches()[0] if len(batch) else batch, None
            elif rest is not None:
                batch = rest
            if batch is None or not len(batch):
                continue
            grp, mid, out, inn, ids, far = (batch.column(c).to_numpy() for c in range(6))
            edges = np.flatnonzero((np.diff(grp) != 0) | (np.diff(mid) != 0)) + 1
            if out[-1] and batch is not rest:
                # more that it leads to may follow; these rows are few
                cut = int(edges[-1]) if len(edges) else 0
                batch, rest = batch.slice(0, cut), batch.slice(cut)
                grp, mid, out, inn, ids, far, edges = grp[:cut], mid[:cut], out[:cut], inn[:cut], ids[:cut], far[:cut], edges[:-1]
            if not len(ids):
                continue
            x, node = matrix(batch.column(6)), np.zeros(len(ids), np.int64)
            node[edges] = 1
            node = np.cumsum(node)
            away, came = out == 1, np.flatnonzero(inn == 1)
            to, to_ids, to_node = x[away], ids[away], node[away]
            if last == (grp[0], mid[0]):
                to, to_ids, to_node = np.concatenate([held_x, to]), np.concatenate([held, to_ids]), np.concatenate([np.zeros(len(held), np.int64), to_node])
            start = np.searchsorted(to_node, np.arange(node[-1] + 2))
            sizes = np.diff(start)[node[came]]
            upto, begin = np.cumsum(sizes), 0
            while begin < len(came):
                end = max(begin + 1, int(np.searchsorted(upto, PAIRS + (upto[begin - 1] if begin else 0), side="right")))
                n = sizes[begin:end]
                row = np.repeat(came[begin:end], n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[node[row]]
                dist = np.zeros(len(row))
                for c in range(x.shape[1]):
                    dist += (x[row, c] - to[at, c]) ** 2
                fits = (dist <= far[row]) & (ids[row] != to_ids[at])
                row, at, dist = row[fits], at[fits], dist[fits]
                order = np.lexsort((to_ids[at], dist, row))
                row, at, dist = row[order], at[order], dist[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < degree
                row, at = row[top], at[top]
                yield pa.RecordBatch.from_arrays([pa.array(grp[row]), pa.array(ids[row]), pa.array(to_ids[at]), pa.array(dist[top])], ["grp", "src", "dst", "dist"])
                begin = end
            own = to_node == node[-1]
            last, held_x, held = (grp[-1], mid[-1]), to[own], to_ids[own]

    return met.mapInArrow(run, "grp long, src long, dst long, dist double")


def robust_prune(point: np.ndarray, ids: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Positions of the candidates that stay: nearest first, each removing those alpha times nearer to it than to the point."""
    dist = ((vectors - point) ** 2).sum(1)
    alive = np.ones(len(ids), bool)
    out: list[int] = []
    for k in np.lexsort((ids, dist)):
        if not alive[k]:
            continue
        out.append(int(k))
        if len(out) == degree:
            break
        alive &= alpha * alpha * ((vectors - vectors[k]) ** 2).sum(1) > dist
    return out


def vamana_graph(vectors: DataFrame, degree: int, *, pool: int = 64, alpha: float = 1.2, group: str | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """src, pos, dst of variable degree: each node's nearest rows and those it is near to, robustly pruned.

    Candidates are the pool nearest rows of the group (exact, by blocks) instead
    of what incremental searches would meet; each node's list is pruned, the
    edges are also taken backward, and lists over the degree are pruned again.
    Every backward edge counts: a node's candidates are dealt into lists of
    some 4 * degree, each is pruned, and what is left is dealt and pruned again
    until one list is left, so no list grows with the number of rows that point to a node.
    """
    v = materialise(vectors.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind_of(vectors, vector)).alias("v")), "prune-rows")
    near = knn_graph(v, pool, group="grp" if group else None, id_col="id", vector="v").select("src", "dst")

    def pruned(pairs: DataFrame) -> DataFrame:
        # a list is its node's vector and then the candidates', in streams; lists are short
        ends = pairs.select("src", "part", F.lit(1).alias("side"), F.col("dst").alias("id")).unionByName(pairs.select("src", "part", F.lit(0).alias("side"), F.col("src").alias("id")).distinct())
        lists = ends.join(v.select("id", "v"), "id").select("src", "part", "side", "id", "v").repartition("src", "part").sortWithinPartitions("src", "part", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for batch in chain(batches, [None]):
                if batch is not None:
                    batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
                    if not len(batch):
                        continue
                    batch, rest = batch.to_batches()[0], None
                    src, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    edges = np.flatnonzero((np.diff(src) != 0) | (np.diff(part) != 0)) + 1
                    # more of the last list may follow
                    cut = int(edges[-1]) if len(edges) else 0
                    batch, rest = batch.slice(0, cut), batch.slice(cut)
                else:
                    batch, rest = rest, None
                if batch is None or not len(batch):
                    continue
                src, part, side, ids = (batch.column(c).to_numpy() for c in range(4))
                x, rows = matrix(batch.column(4)), []
                edges = np.flatnonzero((np.diff(src) != 0) | (np.diff(part) != 0)) + 1
                for m, n in zip([0, *edges], [*edges, len(src)]):
                    if not side[m]:
                        rows += [(src[m], p + 1, ids[m + 1 + k]) for p, k in enumerate(robust_prune(x[m], ids[m + 1 : n], x[m + 1 : n], degree, alpha))]
                out = np.array(rows, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int32)), pa.array(out[:, 2])], ["src", "pos", "dst"])

        return lists.mapInArrow(run, "src long, pos int, dst long")

    def dealt(pairs: DataFrame, width: int) -> DataFrame:
        """Lists of some width rows of a node's candidates, each from the whole range, by a digest."""
        sizes = pairs.groupBy(F.col("src").alias("of")).agg(F.ceil(F.count("*") / width).cast("int").alias("parts")).where("parts > 1")
        part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
        return pairs.join(sizes, F.col("src") == F.col("of"), "left").select("src", "dst", part.alias("part"))

    forward = materialise(pruned(near.withColumn("part", F.lit(0))), "prune-forward")
    pairs = forward.select("src", "dst").unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    while True:
        lists = materialise(dealt(pairs, 4 * degree), "prune-lists")
        out = materialise(pruned(lists), "prune-edges")
        if lists.where("part > 0").isEmpty():
            return out
        pairs = out.select("src", "dst").distinct()


def hierarchical_graph(vectors: DataFrame, plan: LayerPlan, degree: int, *, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """layer, src, pos, dst: exact graphs of nested random layers, the bottom one (0) of all rows.

    A layer's rows are the first of the seeded order, so an upper layer's are in
    every lower one, and all ids are bottom ids.
    """
    order = shuffle_rows(vectors, seed, id_col)
    placed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v")).join(order, "vec_id")
    sizes = F.array(*(F.lit(s) for s in plan.sizes))
    layered = placed.select("vec_id", "v", F.posexplode(sizes).alias("layer", "size"), "new_pos").where(F.col("new_pos") < F.col("size"))
    graph = knn_graph(layered, degree, group="layer", vector="v")
    return graph.select(F.col("grp").cast("int").alias("layer"), "src", "pos", "dst")


def sharded_hierarchical_graph(rows: DataFrame, degree: int, *, layers: int = 3, segment: int = 32, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """shard_id, layer, src, pos, dst: hierarchical_graph() of every shard of rows, all in one plan, in global ids.

    Each shard's layers follow from its own size; a row's place in its shard is that of the seeded order.
    """
    own = rows.select(F.col("shard_id").cast("long").alias("shard_id"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    counts = own.groupBy("shard_id").agg(F.count("*").alias("n")).collect()
    plans = [(r.shard_id, list(layer_plan(r.n, layers, segment, degree).sizes)) for r in counts]
    sizes = F.broadcast(rows.sparkSession.createDataFrame(plans, "shard_id long, sizes array<long>"))
    order = shuffle_rows(own.select("vec_id").distinct(), seed)
    placed = grouped_rank(own.select("shard_id", "vec_id").join(order, "vec_id"), ["shard_id"], "new_pos", "place")
    layered = placed.join(sizes, "shard_id").select("shard_id", "vec_id", "place", F.posexplode("sizes").alias("layer", "size")).where("place <= size")
    both = (F.col("shard_id") * layers + F.col("layer")).alias("both")
    graph = knn_graph(layered.select("shard_id", "vec_id", both).join(own, ["shard_id", "vec_id"]), degree, group="both", vector="v")
    return graph.select(F.floor(F.col("grp") / layers).cast("long").alias("shard_id"), (F.col("grp") % layers).cast("int").alias("layer"), "src", "pos", "dst")

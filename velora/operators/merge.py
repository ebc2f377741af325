"""Merging shard graphs: local ids to global ones, union, distinct, and a seeded cut to a fixed degree.

Shard graphs are edges (shard_id, src_local, pos, dst_local), assignments have
(shard_id, local_id, vec_id), merged graphs are edges (src, pos, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.ranking import exclusive_prefix_sum, md5_key
from velora.sources.shared import materialise


def translate_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """shard_id, src, pos, dst in global ids; nothing is dropped but edges of unknown local ids."""
    ids = assignment.select("shard_id", F.col("local_id"), "vec_id")
    src = ids.select("shard_id", F.col("local_id").alias("src_local"), F.col("vec_id").alias("src"))
    dst = ids.select("shard_id", F.col("local_id").alias("dst_local"), F.col("vec_id").alias("dst"))
    return edges.join(src, ["shard_id", "src_local"]).join(dst, ["shard_id", "dst_local"]).select("shard_id", "src", "pos", "dst")


def localise_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """The inverse: shard_id, src_local, pos, dst_local of edges in global ids."""
    ids = assignment.select("shard_id", "local_id", "vec_id")
    src = ids.select("shard_id", F.col("local_id").alias("src_local"), F.col("vec_id").alias("src"))
    dst = ids.select("shard_id", F.col("local_id").alias("dst_local"), F.col("vec_id").alias("dst"))
    return edges.join(src, ["shard_id", "src"]).join(dst, ["shard_id", "dst"]).select("shard_id", "src_local", "pos", "dst_local")


def truncate_edges(edges: DataFrame, degree: int, seed: int) -> DataFrame:
    """src, pos (from 1), dst: of a node's distinct neighbours, degree at most by the seeded digest of both ids."""
    order = Window.partitionBy("src").orderBy(md5_key(seed, "src", "dst"), "dst")
    return edges.select("src", "dst").distinct().withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= degree).select("src", "pos", "dst")


def merge_graphs(edges: DataFrame, assignment: DataFrame, degree: int, seed: int = 42, *, require_min: bool = True) -> DataFrame:
    """The merged graph src, pos, dst. The neighbours that stay are a seeded choice, not the nearest.

    require_min: a node with fewer than degree distinct neighbours is an error.
    """
    merged = truncate_edges(translate_edges(edges, assignment), degree, seed)
    # written, so that the count and the caller read it instead of merging twice
    merged = materialise(merged, "merged-edges") if require_min else merged
    if require_min and (short := merged.groupBy("src").count().where(F.col("count") < degree).count()):
        raise ValueError(f"{short} nodes have fewer than {degree} distinct neighbours")
    return merged


def merge_medoids(medoids: DataFrame, assignment: DataFrame) -> DataFrame:
    """shard_id, medoid_id: shard entry points (shard_id, local_id) in global ids."""
    return medoids.join(assignment.select("shard_id", "local_id", "vec_id"), ["shard_id", "local_id"]).select("shard_id", F.col("vec_id").alias("medoid_id"))


def merge_label_medoids(label_medoids: DataFrame, assignment: DataFrame) -> DataFrame:
    """label, medoids (sorted global ids) of (label, shard_id, local_id)."""
    named = label_medoids.join(assignment.select("shard_id", "local_id", "vec_id"), ["shard_id", "local_id"])
    return named.groupBy("label").agg(F.array_sort(F.collect_set("vec_id")).alias("medoids"))


def shard_medoids(assignment: DataFrame) -> DataFrame:
    """shard_id, local_id of the vector nearest to its shard's centre; ties to the smaller id."""
    best = assignment.where("round = 1").groupBy("shard_id").agg(F.min(F.struct("dist", "vec_id", "local_id")).alias("m"))
    return best.select("shard_id", F.col("m.local_id").alias("local_id"))


def node_shard_map(assignment: DataFrame) -> DataFrame:
    """vec_id, shard_id, local_id, range-partitioned and sorted by node and shard."""
    return assignment.select("vec_id", "shard_id", "local_id").repartitionByRange("vec_id").sortWithinPartitions("vec_id", "shard_id")


def merge_stats(assignment: DataFrame) -> DataFrame:
    """One row: n_nodes (largest id plus one), n_elements, n_shards."""
    return assignment.agg((F.max("vec_id") + 1).alias("n_nodes"), F.count("*").alias("n_elements"), F.countDistinct("shard_id").alias("n_shards"))


def union_sort(a: DataFrame, b: DataFrame, key: str = "src") -> DataFrame:
    """Both tables' rows, sorted by the key across partitions."""
    return a.unionByName(b).repartitionByRange(key).sortWithinPartitions(key)


def group_neighbors(edges: DataFrame) -> DataFrame:
    """src, neighbors in order of pos, then dst; repeats stay."""
    return edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda e: e["dst"]).alias("neighbors"))


def concat_group_cut(a: DataFrame, b: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """src, neighbors of two edge lists at once: united, grouped, and cut to degree distinct neighbours by the seeded choice."""
    return group_neighbors(truncate_edges(a.select("src", "dst").unionByName(b.select("src", "dst")), degree, seed))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """degree, n_nodes."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def degree_prefix_sum(edges: DataFrame) -> DataFrame:
    """src, degree, first_edge: where a node's neighbours start if all are laid out in node order."""
    return exclusive_prefix_sum(degrees(edges), "src", "degree", "first_edge")

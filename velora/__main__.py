"""python -m velora COMMAND: the stages of an index as commands over files and tables.

convert, subset, direct-partition, partition, configs, build, merge, truth, search. Vectors
are files by suffix (see sources.vector_files) or Parquet tables; assignments,
centres, graphs and results are Parquet tables in the base folder. Graphs can be
written in the binary formats too. --files names the suffix of vector files, one for
each shard with its id map, and configs writes their build configurations.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.operators import graph, knn, merge, partition, sampling, search
from velora.sources.shard_files import save_build_configs, save_shards
from velora.sources.vector_files import load_vectors, register, save, save_vectors


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="velora", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, **optional: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True, type=int if r.split("_")[-1] in ("size", "degree", "k", "itop", "rows", "num") else float if r in ("memory_budget", "epsilon") else str)
        for o, default in optional.items():
            p.add_argument(f"--{o}", default=default, type=type(default) if default is not None else str)
        return p

    command("convert", "data_path", "to")
    command("subset", "data_path", "to", "rows")
    command("direct-partition", "data_path", "base_folder", shard_size=1_000_000, dataset_size=0, files="")
    command("partition", "data_path", "base_folder", "memory_budget", "build_degree", "epsilon", max_duplication=2, sampling_rate=0.05, max_iteration=15, minimum_partition_num=1, rule="selective", block_rows=0, element_bytes=4, files="", seed=42)
    command("configs", "data_path", "base_folder", "name", build_degree="64", inter_build_degree="128", files="fbin", query_path="", truth_path="", k=10, batch_size=10)
    command("build", "data_path", "base_folder", "build_degree", method="exact", metric="l2", alpha=1.2, pool=64, layers=3, segment=32, seed=42)
    command("merge", "base_folder", "merge_degree", seed=42, variable=0, to=None, dim=0)
    command("truth", "data_path", "query_path", "to", "top_k", metric="l2")
    command("search", "data_path", "query_path", "base_folder", "top_k", "itop", graph="merged", truth_path=None, to=None, seed=42)
    return top


def assigned(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(f"{a.base_folder}/assignment")


def partition_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    v = load_vectors(spark, a.data_path)
    if a.rule == "ram":
        rows, centers = partition.partition_by_ram(v, a.memory_budget, a.build_degree, a.max_duplication, element_bytes=a.element_bytes, seed=a.seed)
    else:
        rows, centers = partition.partition_by_budget(v, a.memory_budget, a.build_degree, a.max_duplication, epsilon=a.epsilon, block_rows=a.block_rows or None, rate=a.sampling_rate, min_parts=a.minimum_partition_num, max_iter=a.max_iteration, element_bytes=a.element_bytes, seed=a.seed)
    partition.local_ids(rows).write.mode("overwrite").partitionBy("shard_id").parquet(f"{a.base_folder}/assignment")
    if a.files:
        save_shards(assigned(spark, a), v, a.base_folder, a.files)
    if centers is not None:
        centers.write.mode("overwrite").parquet(f"{a.base_folder}/centers")
    return partition.replication_factor(assigned(spark, a)).first().asDict()


def build_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    v = load_vectors(spark, a.data_path).select("vec_id", "embedding")
    rows = assigned(spark, a).select("shard_id", "vec_id").join(v, "vec_id")
    if a.method == "exact":
        edges = knn.knn_graph(rows, a.build_degree, group="shard_id", metric=a.metric).withColumnRenamed("grp", "shard_id")
        edges.write.mode("overwrite").parquet(f"{a.base_folder}/shard_graph")
    elif a.method == "hierarchical":
        graph.sharded_hierarchical_graph(rows, a.build_degree, layers=a.layers, segment=a.segment, seed=a.seed).write.mode("overwrite").parquet(f"{a.base_folder}/shard_graph")
    else:
        # a row's node is its shard and id together, so that graphs of different shards stay apart
        ids = [r.shard_id for r in rows.select("shard_id").distinct().collect()]
        for k, shard in enumerate(sorted(ids)):
            own = rows.where(F.col("shard_id") == shard)
            edges = graph.nn_descent(own, a.build_degree, seed=a.seed) if a.method == "descent" else graph.vamana_graph(own, a.build_degree, pool=a.pool, alpha=a.alpha)
            edges.select(F.lit(shard).cast("long").alias("shard_id"), "src", "pos", "dst").write.mode("overwrite" if not k else "append").parquet(f"{a.base_folder}/shard_graph")
    return {"edges": spark.read.parquet(f"{a.base_folder}/shard_graph").count()}


def merge_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    edges, rows = spark.read.parquet(f"{a.base_folder}/shard_graph"), assigned(spark, a)
    # of hierarchies, the bottom layers are merged
    edges = edges.where("layer = 0").drop("layer") if "layer" in edges.columns else edges
    merged = merge.merge_graphs(merge.localise_edges(edges, rows), rows, a.merge_degree, a.seed, require_min=not a.variable)
    merged.write.mode("overwrite").parquet(f"{a.base_folder}/merged_graph")
    merge.merge_medoids(merge.shard_medoids(rows), rows).write.mode("overwrite").parquet(f"{a.base_folder}/medoids")
    merged = spark.read.parquet(f"{a.base_folder}/merged_graph")
    if a.to:
        register(spark)
        save(merged, "variablegraph" if a.variable else "fixedgraph", a.to, **({"width": a.merge_degree} if a.variable else {"dim": a.dim}))
    return merge.merge_stats(rows).first().asDict() | {"edges": merged.count()}


def queries_of(spark: SparkSession, path: str) -> DataFrame:
    return load_vectors(spark, path).select(F.col("vec_id").alias("query_id"), "embedding")


def search_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    v, q = load_vectors(spark, a.data_path).select("vec_id", "embedding"), queries_of(spark, a.query_path)
    if a.graph == "shards":
        each = search.sharded_search(q, v, spark.read.parquet(f"{a.base_folder}/shard_graph"), assigned(spark, a), a.top_k, a.itop, a.seed)
        found, stats = knn.merge_topk(each, a.top_k), {}
    else:
        found = search.beam_search(q, v, spark.read.parquet(f"{a.base_folder}/merged_graph"), sampling.start_points(q, v, a.itop, a.seed), a.top_k, a.itop)
        stats = None
    path = a.to or f"{a.base_folder}/results"
    found.write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path)
    out = search.search_stats(found).first().asDict() if stats is None else stats
    if a.truth_path:
        register(spark)
        truth = spark.read.parquet(a.truth_path) if a.truth_path.rstrip("/").endswith(".parquet") else spark.read.format("groundtruth").load(a.truth_path)
        out |= search.recall_at_k(found, truth, a.top_k).first().asDict()
    return out


def run(spark: SparkSession, arguments: list[str] | None = None) -> dict:
    """Run a command; what it reports."""
    a = parser().parse_args(arguments)
    if a.command == "convert":
        save_vectors(load_vectors(spark, a.data_path), a.to)
        return {}
    if a.command == "subset":
        save_vectors(sampling.subset_first_n(load_vectors(spark, a.data_path), a.rows), a.to)
        return {}
    if a.command == "direct-partition":
        v = load_vectors(spark, a.data_path)
        v = sampling.subset_first_n(v, a.dataset_size) if a.dataset_size else v
        partition.partition_range(v, a.shard_size).withColumns({"round": F.lit(1), "dist": F.lit(0.0)}).write.mode("overwrite").partitionBy("shard_id").parquet(f"{a.base_folder}/assignment")
        if a.files:
            save_shards(assigned(spark, a), v, a.base_folder, a.files)
        return {"shards": assigned(spark, a).select("shard_id").distinct().count()}
    if a.command == "configs":
        shards = sorted(r[0] for r in assigned(spark, a).select("shard_id").distinct().collect())
        dims = load_vectors(spark, a.data_path).select(F.size("embedding")).first()[0]
        numbers = lambda text: [int(x) for x in text.split(",")]
        return {"configs": save_build_configs(shards, a.base_folder, a.name, dims, numbers(a.build_degree), numbers(a.inter_build_degree), suffix=a.files, query_file=a.query_path, truth_file=a.truth_path, k=a.k, batch=a.batch_size)}
    if a.command == "truth":
        knn.exact_knn(queries_of(spark, a.query_path), load_vectors(spark, a.data_path), a.top_k, metric=a.metric, query_id="query_id", skip_self=False).write.mode("overwrite").parquet(a.to)
        return {}
    return {"partition": partition_command, "build": build_command, "merge": merge_command, "search": search_command}[a.command](spark, a)


if __name__ == "__main__":
    print(json.dumps(run(SparkSession.builder.appName("velora").getOrCreate())))


__all__ = ["parser", "run"]

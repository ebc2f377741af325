"""What a build of each shard by other programs needs, as files: partition<i>/data.*, idmap.ibin, build configurations; label medoids as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.sources.vector_files import BIN_TYPES, opened, register, save


# Fixed values of the build configurations.
ALGORITHM, BUILD_ALGORITHM = "raft_cagra", "NN_DESCENT"


def shard_folder(base: str, shard: int) -> str:
    return f"{base.rstrip('/')}/partition{shard}"


def _make(folder: str) -> None:
    fs, name = opened(folder)
    fs.create_dir(name, recursive=True)


def save_shards(assignment: DataFrame, vectors: DataFrame, base: str, suffix: str = "fbin", id_col: str = "vec_id", vector: str = "embedding") -> dict[int, int]:
    """One vector file and one id map for each shard, rows in order of local_id; the rows of each shard.

    assignment has shard_id, vec_id, local_id. A shard's file is one ordered file, so
    shards are written one after the other, each by as many tasks as its rows need; a
    shard without rows has no folder.
    """
    register(vectors.sparkSession)
    format = "vecbin" if suffix in BIN_TYPES else "vecs"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    sizes = {r[0]: r[1] for r in assignment.groupBy("shard_id").count().orderBy("shard_id").collect()}
    for shard in sizes:
        folder, rows = shard_folder(base, shard), assignment.where(F.col("shard_id") == shard).select("vec_id", "local_id")
        _make(folder)
        save(rows, "idmap", f"{folder}/idmap.ibin")
        save(own.join(rows, "vec_id").select(F.col("local_id").alias("vec_id"), "embedding"), format, f"{folder}/data.{suffix}")
    return sizes


def save_build_configs(shards: list[int], base: str, name: str, dims: int, degrees: list[int], intermediate: list[int], *, suffix: str = "fbin", query_file: str = "", truth_file: str = "", k: int = 10, batch: int = 10) -> list[str]:
    """partition<i>/<name>.json for each shard: its dataset and one build for each pair of degrees that fits; the paths."""
    out = []
    for shard in shards:
        folder = shard_folder(base, shard)
        builds = []
        for high in intermediate:
            for low in (d for d in degrees if d <= high):
                label = f"{ALGORITHM}.graph_degree{low}.intermediate_graph_degree{high}.graph_build_algo{BUILD_ALGORITHM}"
                builds.append({"algo": ALGORITHM, "build_param": {"graph_degree": low, "intermediate_graph_degree": high, "graph_build_algo": BUILD_ALGORITHM}, "name": label, "file": f"{folder}/index/{label}", "search_params": []})
        dataset = {"name": name, "base_file": f"{folder}/data.{suffix}", "dims": dims, "query_file": query_file, "groundtruth_neighbors_file": truth_file, "distance": "euclidean"}
        _make(folder)
        fs, path = opened(f"{folder}/{name}.json")
        with fs.open_output_stream(path) as f:
            f.write(json.dumps({"dataset": dataset, "search_basic_param": {"k": k, "batch_size": batch}, "index": builds}, indent=4).encode())
        out.append(f"{folder}/{name}.json")
    return out


def save_label_medoids(found: DataFrame, path: str) -> None:
    """A folder of text: a line for each label, "label, medoid, medoid"."""
    found.select(F.concat_ws(", ", F.col("label").cast("string"), F.array_join(F.transform("medoids", lambda m: m.cast("string")), ", "))).write.mode("overwrite").text(path)

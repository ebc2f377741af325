"""The commands end to end, over files."""

import numpy as np

from velora.__main__ import run


def test_index_from_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    np.save(f"{tmp_path}/base.npy", rng.normal(size=(300, 8)).astype(np.float32))
    go = lambda *a: run(spark, [str(x) for x in a])
    base, fbin, few = f"{tmp_path}/index", f"{tmp_path}/base.fbin", f"{tmp_path}/few.fvecs"
    go("convert", "--data_path", f"{tmp_path}/base.npy", "--to", fbin)
    go("subset", "--data_path", fbin, "--to", few, "--rows", 20)
    assert go("direct-partition", "--data_path", fbin, "--base_folder", f"{tmp_path}/direct", "--shard_size", 100) == {"shards": 3}
    budget = 300 * 8 * 4 * 4 / 2**30
    made = go("partition", "--data_path", fbin, "--base_folder", base, "--memory_budget", budget, "--build_degree", 8, "--epsilon", 1.3, "--sampling_rate", 0.5)
    assert made["n_vectors"] == 300 and made["replication"] > 1
    assert go("build", "--data_path", fbin, "--base_folder", base, "--build_degree", 8)["edges"] > 2000
    assert go("merge", "--base_folder", base, "--merge_degree", 8, "--to", f"{tmp_path}/graph", "--dim", 8)["n_nodes"] == 300
    go("truth", "--data_path", fbin, "--query_path", few, "--to", f"{tmp_path}/truth.parquet", "--top_k", 5)
    for kind in ("merged", "shards"):
        found = go("search", "--data_path", fbin, "--query_path", few, "--base_folder", base, "--top_k", 5, "--itop", 64, "--graph", kind, "--truth_path", f"{tmp_path}/truth.parquet")
        assert found["recall"] > 85


def test_shards_as_files(spark, tmp_path):
    import json

    from velora.operators.merge import merge_label_medoids
    from velora.sources.shard_files import save_label_medoids
    from velora.sources.vector_files import load_vectors, register

    x = np.arange(200, dtype=np.float32).reshape(50, 4)
    np.save(f"{tmp_path}/base.npy", x)
    go = lambda *a: run(spark, [str(a) for a in a])
    base = f"{tmp_path}/direct"
    assert go("direct-partition", "--data_path", f"{tmp_path}/base.npy", "--base_folder", base, "--shard_size", 20, "--dataset_size", 45, "--files", "fbin") == {"shards": 3}
    register(spark)
    for shard, n in enumerate((20, 20, 5)):
        ids = spark.read.format("idmap").load(f"{base}/partition{shard}/idmap.ibin").orderBy("local_id").collect()
        assert [tuple(r) for r in ids] == [(k, 20 * shard + k) for k in range(n)]
        rows = load_vectors(spark, f"{base}/partition{shard}/data.fbin").orderBy("vec_id").collect()
        assert [r.embedding for r in rows] == x[20 * shard : 20 * shard + n].tolist()
    made = go("configs", "--data_path", f"{tmp_path}/base.npy", "--base_folder", base, "--name", "set", "--build_degree", "32,64", "--inter_build_degree", "48,64")["configs"]
    assert len(made) == 3
    config = json.load(open(made[2]))
    assert config["dataset"]["dims"] == 4 and config["dataset"]["base_file"] == f"{base}/partition2/data.fbin"
    assert [(i["build_param"]["graph_degree"], i["build_param"]["intermediate_graph_degree"]) for i in config["index"]] == [(32, 48), (32, 64), (64, 64)]
    rows = spark.createDataFrame([(0, 0, 7), (0, 1, 9), (1, 0, 8)], "shard_id int, local_id long, vec_id long")
    found = merge_label_medoids(spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 0)], "label string, shard_id int, local_id long"), rows)
    save_label_medoids(found, f"{tmp_path}/labels")
    lines = {r[0] for r in spark.read.text(f"{tmp_path}/labels").collect()}
    assert {tuple([x.split(", ")[0], *sorted(x.split(", ")[1:])]) for x in lines} == {("a", "8", "9"), ("b", "7")}

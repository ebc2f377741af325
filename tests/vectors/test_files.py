"""Binary formats: round trips, byte for byte layouts, and errors."""

import struct

import numpy as np
import pytest

from velora.operators import graph, knn
from velora.functions.planning import layer_plan, layered_index_size
from velora.sources.vector_files import register, save
from velora.streaming.assign import assign_stream, read_vectors


@pytest.fixture(scope="module")
def session(spark):
    register(spark)
    return spark


def frame(spark, n=50, dim=4, top=250):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(0, top, dim)]) for i in range(n)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("format,suffix", [("vecbin", "fbin"), ("vecbin", "u8bin"), ("vecbin", "ibin"), ("vecs", "fvecs"), ("vecs", "bvecs"), ("vecs", "ivecs")])
def test_vectors_round_trip(session, tmp_path, format, suffix):
    df, path = frame(session), f"{tmp_path}/x.{suffix}"
    save(df, format, path)
    back = session.read.format(format).load(path)
    assert sorted((r.vec_id, tuple(map(float, r.embedding))) for r in back.collect()) == sorted((r.vec_id, tuple(r.embedding)) for r in df.collect())
    size = {"f": 4, "u": 1, "i": 4, "b": 1}[suffix[0]]
    data = open(path, "rb").read()
    assert len(data) == (8 + 50 * 4 * size if format == "vecbin" else 50 * (4 + 4 * size))
    assert struct.unpack("<I", data[:4])[0] == (50 if format == "vecbin" else 4)
    assert [p.name for p in tmp_path.iterdir()] == [f"x.{suffix}"]


def test_ids_and_truth(session, tmp_path):
    ids = session.createDataFrame([(i, 1000 - i) for i in range(30)], "local_id long, vec_id long")
    save(ids, "idmap", f"{tmp_path}/idmap.ibin")
    assert sorted(session.read.format("idmap").load(f"{tmp_path}/idmap.ibin").collect()) == sorted(ids.collect())
    (tmp_path / "gt").write_bytes(struct.pack("<II", 2, 3) + np.array([5, 6, 7, 8, 9, 1], "<i4").tobytes() + b"distances")
    assert [tuple(r) for r in session.read.format("groundtruth").load(f"{tmp_path}/gt").orderBy("query_id", "rank").collect()] == [(0, 1, 5), (0, 2, 6), (0, 3, 7), (1, 1, 8), (1, 2, 9), (1, 3, 1)]
    (tmp_path / "short").write_bytes(struct.pack("<I", 9))
    with pytest.raises(Exception, match="ids"):
        session.read.format("idmap").load(f"{tmp_path}/short").collect()


def test_graphs_round_trip(session, tmp_path):
    edges = knn.knn_graph(frame(session), 5).drop("grp")
    want = sorted(tuple(r) for r in edges.collect())
    save(edges, "fixedgraph", f"{tmp_path}/fixed", dim=4)
    assert sorted(tuple(r) for r in session.read.format("fixedgraph").load(f"{tmp_path}/fixed").collect()) == want
    data = (tmp_path / "fixed").read_bytes()
    assert data[:4] == b"<f4\0" and np.frombuffer(data, "<u4", 50 * 5, 790).tolist() == [d for _, _, d in want]
    save(edges.where("pos <= 1 + src % 5"), "variablegraph", f"{tmp_path}/variable", width=5, medoid=3)
    back = session.read.format("variablegraph").load(f"{tmp_path}/variable").collect()
    assert sorted(tuple(r) for r in back) == sorted(x for x in want if x[1] <= 1 + x[0] % 5)
    data = (tmp_path / "variable").read_bytes()
    assert struct.unpack_from("<QIIQ", data) == (len(data), 5, 3, 0)


def test_layered_graph(session, tmp_path):
    plan, k = layer_plan(50, 2, 10, 4), 4
    layers = graph.hierarchical_graph(frame(session), plan, k)
    rows = {(r.layer, r.src, r.pos): r.dst for r in layers.collect()}
    upper = sorted({s for layer, s, _ in rows if layer == 1})
    body = b"".join(np.array([rows[0, s, p] for p in range(1, k + 1)], "<u4").tobytes() for s in range(50))
    body += b"".join(np.array([upper.index(rows[1, s, p]) for p in range(1, k + 1)], "<u4").tobytes() for s in upper)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    data = pad(body) + 2 * pad(np.array(upper, "<u4").tobytes()) + b"\0" * 8
    assert len(data) == layered_index_size(plan, k)
    (tmp_path / "layers").write_bytes(data)
    back = session.read.format("layeredgraph").options(rows=50, layers=2, segment=10, degree=k).load(f"{tmp_path}/layers")
    assert {(r.layer, r.src, r.pos): r.dst for r in back.collect()} == rows


def test_errors(session, tmp_path):
    with pytest.raises(Exception, match="suffix"):
        session.read.format("vecbin").load(f"{tmp_path}/x.i8bin").collect()
    (tmp_path / "y.fbin").write_bytes(struct.pack("<II", 10, 4))
    with pytest.raises(Exception, match="shorter"):
        session.read.format("vecbin").load(f"{tmp_path}/y.fbin").collect()
    with pytest.raises(Exception, match="dimensions|widths"):
        save(session.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), "vecbin", f"{tmp_path}/z.fbin")


def test_stream_is_assigned_like_a_table(session, tmp_path):
    from velora.operators.partition import partition_knearest

    df = frame(session)
    df.write.parquet(f"{tmp_path}/in")
    centers = df.where("vec_id < 3").selectExpr("vec_id as center_id", "embedding as center")
    assign_stream(read_vectors(session, f"{tmp_path}/in"), centers, f"{tmp_path}/out", f"{tmp_path}/check", copies=2, once=True).awaitTermination()
    got = session.read.parquet(f"{tmp_path}/out").select("shard_id", "vec_id", "round").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, partition_knearest(df, centers, 2).select("shard_id", "vec_id", "round").collect()))

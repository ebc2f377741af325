"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: The rest of the pairs is the same operators once more; these cover each.
NAMES = ["scan_vectors", "cast_to_float", "shuffle_rows", "kmeans_sample", "start_points", "cosine_similarity", "partition_plan", "ggnn_layer_plan", "ggnn_index_size", "kmeans_lloyd_step", "kmeans_pp_pick", "partition_selective", "partition_overlap_avg", "shard_medoids", "degree_prefix_sum", "hierarchical_graph", "merge_graph", "exact_knn", "beam_search_full_pool", "sharded_search_full_pool", "merge_topk", "recall_at_k"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(frame: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

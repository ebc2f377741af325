"""Operators against sequential NumPy models."""

import numpy as np
import pytest

from velora.functions import planning
from velora.functions.ranking import exclusive_prefix_sum, grouped_rank
from velora.operators import graph, kmeans, knn, merge, partition, sampling, search

N, DIM = 240, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    return rng.normal(size=(N, DIM)).round(3) + rng.integers(0, 3, size=(N, 1))


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def centers(spark, data):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data[:6] * 0.9)], "center_id long, center array<double>").cache()


def distances(data):
    c = data[:6] * 0.9
    return ((data[:, None, :] - c[None, :, :]) ** 2).sum(-1)


def selective_model(d, copies, limit, epsilon):
    n, m = d.shape
    order = np.argsort(d, axis=1, kind="stable")
    r1, tot, r2, radius, own, rows = np.zeros(m, int), np.zeros(m, int), np.zeros(m, int), np.zeros(m), {}, set()
    for p in range(n):
        for c in order[p]:
            if r1[c] > int(0.8 * limit) or tot[c] > limit:
                continue
            r1[c] += 1
            tot[c] += 1
            radius[c] = max(radius[c], d[p, c])
            own[p] = c
            rows.add((int(c), p, 1))
            break
    lim2 = limit - r1
    for p in range(n):
        if p not in own:
            rows.add((int(order[p, 0]), p, 0))
            continue
        taken = 0
        for c in order[p]:
            if taken == copies - 1:
                break
            if c == own[p] or r2[c] > lim2[c] or tot[c] > limit:
                continue
            if d[p, c] >= epsilon * d[p, own[p]]:
                break
            if d[p, c] < 2 * epsilon * radius[c]:
                r2[c] += 1
                tot[c] += 1
                taken += 1
                rows.add((int(c), p, 2))
    return rows


@pytest.mark.parametrize("copies,limit,epsilon", [(2, 120, 1.2), (2, 48, 1.5), (3, 45, 1.6), (2, 35, 1.2), (1, 60, 1.1)])
def test_selective_partition_is_the_sequential_one(vectors, centers, data, copies, limit, epsilon):
    got = partition.partition_selective(vectors, centers, copies, limit, epsilon).collect()
    assert {(r.shard_id, r.vec_id, r.round) for r in got} == selective_model(distances(data), copies, limit, epsilon)
    assert len(got) == len({(r.shard_id, r.vec_id) for r in got})
    assert {r.vec_id for r in got} == set(range(N))


@pytest.mark.parametrize("limit,rows", [(60, 100), (48, 70)])
def test_selective_partition_in_blocks(vectors, centers, data, limit, rows):
    """Ranges of ids one after the other: shares are smoothed, counts and radii carry over."""
    d = distances(data)
    order, m, most = np.argsort(d, axis=1, kind="stable"), 6, int(0.8 * limit)
    r1, r2, radius, share, want = np.zeros(m, int), np.zeros(m, int), np.zeros(m), np.full(m, 1 / m), set()
    blocks = -(-N // rows)
    for b in range(blocks):
        own, before = {}, r1.copy()
        block = range(b * rows, min(N, (b + 1) * rows))
        for p in block:
            c = next((c for c in order[p] if r1[c] <= most and r1[c] + r2[c] <= limit), None)
            if c is None:
                want.add((int(order[p][0]), p, 0))
                continue
            own[p] = c
            r1[c] += 1
            radius[c] = max(radius[c], d[p, c])
            want.add((int(c), p, 1))
        share = (share * (b + 1) + (r1 - before) / len(block)) / (b + 2)
        most2 = limit - r1 if b == blocks - 1 else np.maximum(limit - (share * N).astype(int), limit - most)
        for p in block:
            for c in order[p]:
                if p not in own or c == own[p] or r2[c] > most2[c] or r1[c] + r2[c] > limit:
                    continue
                if d[p, c] >= 1.5 * d[p, own[p]]:
                    break
                if d[p, c] < 1.5 * (1 + 1 / (b + 1)) * radius[c]:
                    r2[c] += 1
                    want.add((int(c), p, 2))
                    break
    got = {(r.shard_id, r.vec_id, r.round) for r in partition.partition_selective(vectors, centers, 2, limit, 1.5, block_rows=rows).collect()}
    assert got == want


def test_partitions_with_more_centers_than_a_task_holds(vectors, centers, monkeypatch):
    rules = [lambda: partition.partition_selective(vectors, centers, 2, 48, 1.5), lambda: partition.partition_overlap(vectors, centers, 2, 70, 1.4)]
    rows = lambda rule: sorted((r.shard_id, r.vec_id, r.round) for r in rule().collect())
    want = [rows(r) for r in rules]
    monkeypatch.setattr(kmeans, "CENTER_BYTES", 10)
    monkeypatch.setattr(partition, "CENTER_BYTES", 10)
    assert [rows(r) for r in rules] == want


@pytest.mark.parametrize("limit", [30, 85, 100, 500])
def test_nonselective_partition(vectors, centers, data, limit):
    d = distances(data)
    counts, want = np.zeros(6, int), set()
    for p in range(N):
        need = 2
        order = np.argsort(d[p], kind="stable")
        for k, c in enumerate(order):
            if need and (counts[c] < limit or len(order) - k <= need):
                counts[c] += 1
                need -= 1
                want.add((int(c), p))
    assert {(r.shard_id, r.vec_id) for r in partition.partition_nonselective(vectors, centers, 2, limit).collect()} == want


@pytest.mark.parametrize("limit", [30, 40, 70, 500])
def test_overlap_partition(vectors, centers, data, limit):
    d = distances(data)
    counts, want = np.zeros(6, int), set()
    for p in range(N):
        total = passed = taken = 0
        mean = np.inf
        for c in np.argsort(d[p], kind="stable"):
            if taken < 2 and d[p, c] <= 1.4 * mean:
                total, passed = total + d[p, c], passed + 1
                mean = total / passed
                if counts[c] < limit:
                    counts[c] += 1
                    taken += 1
                    want.add((int(c), p))
                else:
                    mean = np.inf
    assert {(r.shard_id, r.vec_id) for r in partition.partition_overlap(vectors, centers, 2, limit, 1.4).collect()} == want


def test_replication_grows_with_epsilon(vectors, centers):
    sizes = [partition.partition_selective(vectors, centers, 2, 200, e).count() for e in (1.0, 1.2, 1.5, 2.0)]
    assert sizes == sorted(sizes) and sizes[0] == N


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_knn(vectors, data, metric, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 50)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    all_d = {"l2": ((data[:, None] - data[None]) ** 2).sum(-1), "ip": -(data @ data.T), "cosine": 1 - unit @ unit.T}[metric]
    got = knn.exact_knn(vectors.where("vec_id % 10 = 0"), vectors, 5, metric=metric).collect()
    for q in range(0, N, 10):
        d = all_d[q].copy()
        d[q] = np.inf
        assert [r.neighbor_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(N), d.round(9)))[:5].tolist()


def test_knn_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in (9, 4, 7, 1)] + [(20, None)], "vec_id long, embedding array<double>")
    assert sorted((r.src, r.dst) for r in knn.knn_graph(v, 2).collect()) == [(1, 4), (1, 7), (4, 1), (4, 7), (7, 1), (7, 4), (9, 1), (9, 4)]


def test_one_large_group_is_many_bounded_units(vectors, data, monkeypatch):
    monkeypatch.setattr(knn, "UNIT_PAIRS", 400)
    monkeypatch.setattr(knn, "UNITS", 1000)
    rows = vectors.selectExpr("0L as grp", "vec_id as id", "embedding as v")
    sizes = knn.units_of(rows, rows).groupBy("grp", "at", "part", "side").count().collect()
    assert len(sizes) == 2 * 24 * 6 and max(r["count"] for r in sizes) < 80
    monkeypatch.setattr(knn, "BLOCK", 3)
    got = {(r.src, r.pos): r.dst for r in knn.knn_graph(vectors.selectExpr("*", "7 as g"), 5, group="g").collect()}
    d = ((data[:, None, :] - data[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got == {(i, p + 1): int(near[i, p]) for i in range(N) for p in range(5)}


def test_empty_tables(vectors, centers):
    none = vectors.limit(0)
    assert knn.knn_graph(none, 3).count() == 0
    assert partition.partition_selective(none, centers, 2, 10, 1.2).count() == 0
    assert kmeans.kmeans_assign(none, centers).count() == 0
    assert sampling.shuffle_rows(none, 1).count() == 0


def beam_model(data, edges, q, seeds, k, width):
    dist = lambda i: float(((data[i] - q) ** 2).sum())
    pool = sorted((dist(i), i) for i in set(seeds))[:width]
    done, visited, n_distance = set(), set(), len(set(seeds))
    while left := [x for x in pool if x[1] not in done]:
        at = left[0][1]
        done.add(at)
        for j in edges.get(at, []):
            if j not in visited:
                visited.add(j)
                n_distance += 1
                if j not in {i for _, i in pool}:
                    pool = sorted([*pool, (dist(j), j)])[:width]
    return [i for _, i in pool[:k]], len(visited), n_distance


@pytest.mark.parametrize("form", ["packed", "joins"])
def test_beam_search_is_the_sequential_one(spark, vectors, data, form):
    edges_df = knn.knn_graph(vectors, 6).drop("grp").cache()
    queries = vectors.where("vec_id % 60 = 0").selectExpr("vec_id as query_id", "embedding")
    seeds = sampling.start_points(queries, vectors, 8, 3).cache()
    edges: dict = {}
    for r in sorted(edges_df.collect(), key=lambda r: (r.src, r.pos)):
        edges.setdefault(r.src, []).append(r.dst)
    fn = search.beam_search if form == "packed" else search.beam_search_joins
    got = fn(queries, vectors, edges_df, seeds, 4, 8).collect()
    for q in range(0, N, 60):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        want, visits, dists = beam_model(data, edges, data[q], [r.vec_id for r in seeds.collect() if r.query_id == q], 4, 8)
        assert ([r.neighbor_id for r in mine], mine[0].n_visited, mine[0].n_distance) == (want, visits, dists)


def random_graph(seed, n=60):
    rng = np.random.default_rng(seed)
    points, ids = rng.integers(0, 4, size=(n, 3)).astype(np.float32), rng.permutation(n) * 7
    src = np.repeat(ids, 4)
    return rng, search.Packed(ids, points, src, np.where(rng.random(len(src)) < 0.1, -1, rng.choice(ids, len(src))))


@pytest.mark.parametrize("seed", range(3))
def test_searches_of_many_queries_at_once_are_the_single_ones(seed):
    rng, g = random_graph(seed)
    n, q = len(g.ids), rng.normal(size=(9, 3))
    for width in (1, 6, n):
        seeds = np.stack([rng.choice(n, min(width, 5), replace=False) for _ in q])
        seeds[0, 1:] = n
        pool, dist, visits, distances = g.beams(q, seeds, width, g.table())
        for i, x in enumerate(q):
            rows, d, a, b = g.beam(x, seeds[i][seeds[i] < n], width)
            assert pool[i][pool[i] < n].tolist() == rows.tolist() and dist[i][: len(d)].tolist() == d.tolist() and (visits[i], distances[i]) == (a, b)
    row, ids, dist, visits, distances = g.whole(np.arange(9), q, 5)
    for i, x in enumerate(q):
        rows, d, a, b = g.beam(x, np.arange(n), n)
        assert ids[row == i].tolist() == g.ids[rows[:5]].tolist() and dist[row == i].tolist() == d[:5].tolist() and (visits, distances) == (a, b)


def test_pool_for_all_rows_needs_no_rows_of_seeds(spark, vectors):
    edges = knn.knn_graph(vectors, 4).select("src", "pos", "dst")
    asked = vectors.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda seeds, width, **how: sorted(tuple(r)[:6] for r in search.beam_search(asked, vectors, edges, seeds, 5, width, **how).collect())
    every = sampling.start_points(asked, vectors, N, 42)
    want = rows(every, N)
    assert want and rows(None, N) == want and rows(None, N, graph=search.handed(vectors, edges)) == want
    assert rows(None, 20) == rows(every, 20)


def test_beam_search_refuses_and_falls_back(vectors):
    queries = vectors.where("vec_id = 0").selectExpr("vec_id as query_id", "embedding")
    edges = knn.knn_graph(vectors, 4).drop("grp")
    seeds = sampling.start_points(queries, vectors, 4, 3)
    with pytest.raises(ValueError):
        search.beam_search(queries, vectors, edges, seeds, 5, 4)
    a = search.beam_search(queries, vectors, edges, seeds, 3, 4, packed_bytes=10).select("neighbor_id").collect()
    assert a == search.beam_search(queries, vectors, edges, seeds, 3, 4).select("neighbor_id").collect()


def test_sharded_hierarchical_search_is_hierarchical_search_of_each_shard(spark, vectors):
    rows = vectors.selectExpr("vec_id", "embedding", "cast(vec_id % 2 as int) as shard_id").cache()
    layers = graph.sharded_hierarchical_graph(rows, 6, layers=3, segment=12).cache()
    queries = vectors.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    got = search.sharded_search(queries, vectors, layers, rows.select("shard_id", "vec_id"), 5, 12).collect()
    assert layers.select("layer").distinct().count() == 3
    for shard in (0, 1):
        own = layers.where(f"shard_id = {shard}").drop("shard_id")
        top = sorted(r[0] for r in own.where("layer = 2").select("src").distinct().collect())
        seeds = [(q, top[k]) for q in range(0, N, 40) for k in sampling.start_places(42, q, len(top), 12, f":{shard}")]
        want = search.hierarchical_search(queries, rows.where(f"shard_id = {shard}"), own, spark.createDataFrame(seeds, "query_id long, vec_id long"), 5, 12).collect()
        key = lambda r: (r.query_id, r["rank"], r.neighbor_id, r.n_visited, r.n_distance)
        assert sorted(key(r) for r in got if r.shard_id == shard) == sorted(map(key, want))


@pytest.mark.parametrize("width, cells, batch", [(6, 1 << 24, 1 << 25), (6, 0, 1 << 25), (6, 1 << 24, 1), (300, 1 << 24, 1 << 25)])
def test_shard_answers_are_single_searches(monkeypatch, width, cells, batch):
    monkeypatch.setattr(search, "TABLE_CELLS", cells)
    monkeypatch.setattr(search, "SHARD_MARKS", batch)
    rng, g = random_graph(5)
    src = np.append(np.repeat(g.ids, np.diff(g.first)), np.full(60, g.ids[0]))
    dst = np.append(g.ids[g.dst], g.ids)
    hub = search.Packed(g.ids, g.vectors, src, dst)
    q, names = rng.normal(size=(9, 3)), np.arange(9) * 100
    got = [f for f in search._shard_answers(3, names, q, g.ids, g.vectors, src, dst, np.zeros(len(src), np.int64), 5, width, 42)]
    got = [tuple(r)[:7] for f in got for r in f[["shard_id", "query_id", "rank", "neighbor_id", "distance", "n_visited", "n_distance"]].itertuples(index=False)]
    want = []
    for i, x in zip(names.tolist(), q):
        rows, d, a, b = hub.beam(x, np.array(sampling.start_places(42, i, len(g.ids), width, ":3")), width)
        want += [(3, i, p + 1, g.ids[rows[p]], d[p], a, b) for p in range(5)]
    assert got == want


def test_hierarchical_search_by_joins_equals_packed(spark, vectors):
    queries = vectors.where("vec_id % 60 = 0").selectExpr("vec_id as query_id", "embedding")
    layers = None
    for layer, step in enumerate((1, 4, 16)):
        own = knn.knn_graph(vectors.where(f"vec_id % {step} = 0"), 4).selectExpr(f"{layer} as layer", "src", "pos", "dst")
        layers = own if layers is None else layers.unionByName(own)
    layers = layers.cache()
    seeds = sampling.start_points(queries, vectors.where("vec_id % 16 = 0"), 2, 3).cache()
    rows = lambda size: sorted((r.query_id, r["rank"], r.neighbor_id, round(r.distance, 6), r.n_visited, r.n_distance) for r in search.hierarchical_search(queries, vectors, layers, seeds, 3, 4, packed_bytes=size).collect())
    packed = rows(search.PACKED_BYTES)
    assert packed and rows(10) == packed


def test_start_points_are_distinct_and_whole_where_few(vectors):
    queries = vectors.where("vec_id < 5").selectExpr("vec_id as query_id", "embedding")
    got = sampling.start_points(queries, vectors, 40, 9)
    assert got.distinct().count() == 200 == got.select("query_id", "vec_id").distinct().count()
    assert sampling.start_points(queries, vectors, 999, 9).count() == 5 * N
    inside = sampling.start_points(queries, vectors, 10, 9, low=100, high=150)
    assert all(100 <= r.vec_id < 150 for r in inside.collect())


def test_merge_checks_degrees_and_keeps_union(spark):
    assignment = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (0, 2, 12), (1, 0, 11), (1, 1, 12), (1, 2, 13)], "shard_id int, local_id long, vec_id long")
    edges = spark.createDataFrame([(s, i, p + 1, j) for s in (0, 1) for i in range(3) for p, j in enumerate(x for x in range(3) if x != i)], "shard_id int, src_local long, pos int, dst_local long")
    full = merge.merge_graphs(edges, assignment, 3, require_min=False)
    assert {(r.src, r.dst) for r in full.collect()} == {(a, b) for s in ((10, 11, 12), (11, 12, 13)) for a in s for b in s if a != b}
    assert merge.merge_graphs(edges, assignment, 2).groupBy("src").count().where("count = 2").count() == 4
    with pytest.raises(ValueError):
        merge.merge_graphs(edges, assignment, 3)


def test_nn_descent_and_pruned_graphs(vectors):
    exact = {(r.src, r.dst) for r in knn.knn_graph(vectors, 6).collect()}
    near = {(r.src, r.dst) for r in graph.nn_descent(vectors, 6).collect()}
    assert len(near) == len(exact) and len(near & exact) / len(exact) > 0.9
    pruned = graph.vamana_graph(vectors, 8, pool=24).groupBy("src").count().collect()
    assert len(pruned) == N and max(r["count"] for r in pruned) <= 8


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_edges_over_two_others_meet_in_streams(spark, data, batch):
    rng = np.random.default_rng(6)
    points = data[:40]
    edges = {(int(s), int(t)) for s, t in rng.integers(0, 40, size=(150, 2)) if s != t} | {(s, 3) for s in range(40) if s != 3}
    far = {i: float(rng.choice([2.0, np.inf])) for i in range(40)}
    both = spark.createDataFrame([(0, s, t, 0.0) for s, t in sorted(edges)], "grp long, src long, dst long, dist double")
    named = spark.createDataFrame([(0, i, points[i].tolist(), far[i]) for i in range(40)], "grp long, id long, v array<double>, far double")
    want = set()
    for m in range(40):
        for s in (a for a, b in edges if b == m):
            d = sorted((((points[s] - points[t]) ** 2).sum(), t) for a, t in edges if a == m and t != s)
            want |= {(s, t) for x, t in [x for x in d if x[0] <= far[s]][:4]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = graph._through(both, named, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.src, r.dst) for r in got} == want
    assert all(abs(r.dist - ((points[r.src] - points[r.dst]) ** 2).sum()) < 1e-9 for r in got)


@pytest.mark.parametrize("batch", [1, 9])
def test_pruned_lists_are_met_in_streams(spark, vectors, batch):
    some = vectors.where("vec_id < 60")
    rows = lambda: sorted(map(tuple, graph.vamana_graph(some, 4, pool=12).collect()))
    want, before = rows(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_kmeans_improves_and_handles_empty_clusters(spark, vectors):
    start = kmeans.kmeans_pp_init(vectors, 5)
    end = kmeans.kmeans_fit(vectors, 5)
    cost = lambda c: kmeans.residual(vectors, c).first().residual
    assert start.count() == end.count() == 5 and cost(end) < cost(start)
    far = spark.createDataFrame([(0, [0.0] * DIM), (1, [1e6] * DIM)], "center_id long, center array<double>")
    assert {r.center_id: r.center[0] for r in kmeans.lloyd_step(vectors, far).collect()}[1] == 1e6
    assert {r.center_id: r.center[0] for r in kmeans.lloyd_step(vectors, far, empty="zero").collect()}[1] == 0


def test_plans():
    assert planning.plan_partitions(1000, 64, 64, 1.0, 2, 4) == (1, 1000)
    parts, limit = planning.plan_partitions(10**6, 128, 64, 0.5, 2, 4)
    assert parts * limit >= 10**6
    plan = planning.layer_plan(1_000_000, 4, 32, 24)
    assert plan.sizes[-1] == 32 and plan.offsets[1] == 1_000_000 and plan.rows == sum(plan.sizes)


def test_ranks_and_prefix_sums(spark):
    rows = [(k % 3 == 0, k * 7 % 101, k) for k in range(101)]
    df = spark.createDataFrame(rows, "g boolean, o long, v long")
    for g in (True, False):
        want = {o: i + 1 for i, o in enumerate(sorted(o for x, o, _ in rows if x == g))}
        assert {r.o: r.rk for r in grouped_rank(df, ["g"], "o", "rk", pieces=7).where(df.g == g).collect()} == want
    sums = {r.o: r.s for r in exclusive_prefix_sum(df, "o", "v", "s", pieces=9).collect()}
    total = 0
    for _, o, v in sorted(rows, key=lambda r: r[1]):
        assert sums[o] == total
        total += v


def test_partition_by_budget_passes_one_partition_through(vectors):
    a, c = partition.partition_by_budget(vectors, 1.0, 16, 2)
    assert c is None and a.count() == N
    a, c = partition.partition_by_budget(vectors, planning.estimate_memory(N, DIM, 16, 4) / 3 / planning.GB, 16, 2, rate=0.5)
    assert c.count() > 3 and a.select("vec_id").distinct().count() == N

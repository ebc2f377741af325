"""Registered queries over the embeddings table, and SQL for those that SQL can express.

Searches take as queries every vector whose id is divisible by 100, against all
vectors. Centres are the labels' mean vectors. Emitted floats are rounded to six
digits; ranks are taken before rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions import planning
from velora.functions import vectors as V
from velora.operators import graph, kmeans, knn, merge, partition, sampling, search
from velora.sources.shared import materialise

K, DEGREE, COPIES, EPSILON, SEED = 10, 8, 2, 1.1, 42
#: Seats of a shard as a share of all vectors: slack with ten centres; and one that is tight.
SHARE, TIGHT_SHARE = 0.24, 0.14


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label")


def asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


def label_centers(v: DataFrame) -> DataFrame:
    return materialise(kmeans.group_means(v, "label", "embedding"), "centers")


def seats(v: DataFrame, share: float = SHARE) -> int:
    return int(share * v.count())


def selective(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return materialise(partition.local_ids(partition.partition_selective(v, label_centers(v), COPIES, seats(v), EPSILON)), "assignment")


def shard_edges(v: DataFrame, assignment: DataFrame, degree: int = DEGREE) -> DataFrame:
    """Exact shard graphs in global ids: shard_id, src, pos, dst."""
    rows = assignment.select("shard_id", "vec_id").join(v.select("vec_id", "embedding"), "vec_id")
    return materialise(knn.knn_graph(rows, degree, group="shard_id").select(F.col("grp").cast("int").alias("shard_id"), "src", "pos", "dst"), "shard-graph")


def merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, assignment, merged graph)."""
    v, a = embeddings(spark, d), selective(spark, d)
    local = merge.localise_edges(shard_edges(v, a), a)
    return v, a, materialise(merge.merge_graphs(local, a, DEGREE, SEED), "merged-graph")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


# SQL pieces. d2 folds a list of (x, y) pairs.


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


VEC = "v as (select vec_id, embedding::double[] as e, label from embeddings)"
CENTERS = f"""{VEC}, means as (
  select label, pos, avg(x) as m from (select label, unnest(e) as x, generate_subscripts(e, 1) as pos from v) group by label, pos
), centers as (select label::bigint as center_id, list(m order by pos) as c from means group by label)"""
NEAR = f"""{CENTERS}, near as (
  select vec_id, center_id, dist, row_number() over (partition by vec_id order by dist, center_id) as rk
  from (select vec_id, center_id, {d2('e', 'c')} as dist from v, centers)
)"""
ASSIGNED = f"""{NEAR}, first_round as (select vec_id, center_id, dist from near where rk = 1),
radii as (select center_id, max(dist) as radius from first_round group by center_id),
second_round as (
  select n.vec_id, n.center_id, n.dist, row_number() over (partition by n.vec_id order by n.dist, n.center_id) as k
  from near n join first_round f on n.vec_id = f.vec_id join radii r on n.center_id = r.center_id
  where n.center_id <> f.center_id and n.dist < {EPSILON}::double * f.dist and n.dist < 2 * {EPSILON}::double * r.radius
), assigned as (
  select center_id::int as shard_id, vec_id, 1 as round, dist from first_round
  union all select center_id::int, vec_id, 2, dist from second_round where k <= {COPIES - 1}
), placed as (
  select *, row_number() over (partition by shard_id order by vec_id) - 1 as local_id from assigned
)"""
SHARD_GRAPH = f"""{ASSIGNED}, shard_graph as (
  select * from (
    select a.shard_id, a.vec_id as src, b.vec_id as dst, a.local_id as src_local, b.local_id as dst_local,
      row_number() over (partition by a.shard_id, a.vec_id order by {d2('x.e', 'y.e')}, b.vec_id) as pos
    from placed a join placed b on a.shard_id = b.shard_id and a.vec_id <> b.vec_id
    join v x on x.vec_id = a.vec_id join v y on y.vec_id = b.vec_id
  ) where pos <= {DEGREE}
)"""


def cut_sql(edges: str, degree: int) -> str:
    return f"""select src, pos, dst from (
  select src, dst, row_number() over (partition by src order by md5(concat_ws(':', '{SEED}', src, dst)), dst) as pos
  from (select distinct src, dst from {edges})) where pos <= {degree}"""


MERGED = f"{SHARD_GRAPH}, merged as ({cut_sql('shard_graph', DEGREE)})"
KNN = f"""{VEC}, truth as (
  select * from (
    select q.vec_id as query_id, b.vec_id as neighbor_id, {d2('q.e', 'b.e')} as distance,
      row_number() over (partition by q.vec_id order by {d2('q.e', 'b.e')}, b.vec_id) as rank
    from v q join v b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0
  ) where rank <= {K}
)"""
KNN_WITH_SELF = KNN.replace("join v b on q.vec_id <> b.vec_id where", "cross join v b where")

# Scans


@query("scan_vectors", f"with {VEC} select vec_id, len(e)::int as dim, round(list_sum(e), 6) as total, label from v")
def scan_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = V.as_double("embedding")
    return embeddings(spark, d).select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "label")


@query("dataset_metadata", "select count(*) as n_rows, max(len(embedding))::int as dim, min(len(embedding)) = max(len(embedding)) as uniform from embeddings")
def dataset_metadata(spark: SparkSession, d: str) -> DataFrame:
    size = F.size("embedding")
    return embeddings(spark, d).agg(F.count("*").alias("n_rows"), F.max(size).alias("dim"), (F.min(size) == F.max(size)).alias("uniform"))


@query("scan_queries", "select vec_id as query_id, len(embedding)::int as dim from embeddings where vec_id % 100 = 0")
def scan_queries(spark: SparkSession, d: str) -> DataFrame:
    return asked(embeddings(spark, d)).select("query_id", F.size("embedding").alias("dim"))


@query("scan_shards", f"with {ASSIGNED} select shard_id, local_id, vec_id from placed")
def scan_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards are written one folder each and discovered when read."""
    from velora.sources.shared import shared_folder

    path = shared_folder(spark, "shards")
    selective(spark, d).write.partitionBy("shard_id").parquet(path)
    return spark.read.parquet(path).select("shard_id", "local_id", "vec_id")


@query("shard_sizes", f"with {ASSIGNED} select shard_id, count(*) as n from assigned group by shard_id")
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    return partition.shard_sizes(selective(spark, d))


@query("degree_prefix_sum", f"with {SHARD_GRAPH}, g as (select distinct src, dst from shard_graph), degs as (select src, count(*) as degree from g group by src) select src, degree, (sum(degree) over (order by src) - degree)::bigint as first_edge from degs")
def degree_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    v, a = embeddings(spark, d), selective(spark, d)
    return merge.degree_prefix_sum(shard_edges(v, a).select("src", "dst").distinct())


# Sinks


@query("shard_medoids", f"with {ASSIGNED} select shard_id, local_id, vec_id as medoid_id from (select *, row_number() over (partition by shard_id order by dist, vec_id) as k from placed where round = 1) where k = 1")
def shard_medoids(spark: SparkSession, d: str) -> DataFrame:
    a = selective(spark, d)
    medoids = merge.shard_medoids(a)
    return medoids.join(merge.merge_medoids(medoids, a), "shard_id")


LABEL_MEDOIDS_SQL = f"""with {ASSIGNED}, ranked as (
  select label, shard_id, placed.vec_id, row_number() over (partition by label, shard_id order by dist, placed.vec_id) as k from placed join v using (vec_id) where round = 1)
select distinct label, vec_id as medoid_id from ranked where k = 1"""


@query("label_medoids", LABEL_MEDOIDS_SQL)
def label_medoids(spark: SparkSession, d: str) -> DataFrame:
    a = selective(spark, d)
    best = a.where("round = 1").join(embeddings(spark, d).select("vec_id", "label"), "vec_id").groupBy("label", "shard_id").agg(F.min(F.struct("dist", "vec_id", "local_id")).alias("m"))
    found = merge.merge_label_medoids(best.select("label", "shard_id", F.col("m.local_id").alias("local_id")), a)
    return found.select("label", F.explode("medoids").alias("medoid_id"))


BUILD_SQL = f"""with {ASSIGNED}, degs(graph_degree, intermediate_degree) as (
  select a.x, b.x from (select unnest([32, 64]) as x) a, (select unnest([64, 128]) as x) b where a.x <= b.x)
select shard_id, n as n_rows, graph_degree, intermediate_degree, 'euclidean' as distance from (select shard_id, count(*) as n from assigned group by shard_id), degs"""


def build_config_rows(assignment: DataFrame, degrees: list[int], intermediate: list[int]) -> DataFrame:
    """One build per shard and pair of degrees; the pairs are a short list."""
    pairs = [(a, b) for a in degrees for b in intermediate if a <= b]
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("graph_degree"), F.lit(b).alias("intermediate_degree")) for a, b in pairs)))
    return partition.shard_sizes(assignment).select("shard_id", F.col("n").alias("n_rows"), both.alias("p")).select("shard_id", "n_rows", "p.*", F.lit("euclidean").alias("distance"))


@query("build_configs", BUILD_SQL)
def build_configs(spark: SparkSession, d: str) -> DataFrame:
    return build_config_rows(selective(spark, d), [32, 64], [64, 128])


BUILD_JSON_SQL = f"select shard_id, graph_degree, intermediate_degree, to_json({{'dataset': {{'shard_id': shard_id, 'n_rows': n_rows, 'distance': distance}}, 'build_param': {{'graph_degree': graph_degree, 'intermediate_degree': intermediate_degree}}}})::varchar as config from ({BUILD_SQL})"


@query("build_configs_json", BUILD_JSON_SQL)
def build_configs_json(spark: SparkSession, d: str) -> DataFrame:
    rows = build_config_rows(selective(spark, d), [32, 64], [64, 128])
    return rows.select("shard_id", "graph_degree", "intermediate_degree", F.to_json(F.struct(F.struct("shard_id", "n_rows", "distance").alias("dataset"), F.struct("graph_degree", "intermediate_degree").alias("build_param"))).alias("config"))


@query("cast_to_float", "select vec_id, pos, x from (select vec_id, unnest(u) / 255.0::double as x, generate_subscripts(u, 1) - 1 as pos from (select vec_id, list_transform(embedding::double[], lambda x: round((x + 1) * 127.5)::int) as u from embeddings))".replace("select vec_id, pos, x", "select vec_id, pos::int as pos, round(x, 6) as x"))
def cast_to_float(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 0 to 255 as floats."""
    u = F.transform(V.as_double("embedding"), lambda x: F.round((x + 1) * 127.5).cast("int"))
    return embeddings(spark, d).select("vec_id", F.posexplode(F.transform(u, lambda x: x.cast("double") / 255.0)).alias("pos", "x")).select("vec_id", "pos", r6("x"))


# Projection, filters and samples


@query("subset_first_n", "select vec_id, label from embeddings where vec_id < 100")
def subset_first_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.subset_first_n(embeddings(spark, d), 100).select("vec_id", "label")


SHUFFLED = f"shuffled as (select vec_id, row_number() over (order by md5(concat_ws(':', '{SEED}', vec_id)), vec_id) - 1 as new_pos from embeddings)"


@query("shuffle_rows", f"with {SHUFFLED} select vec_id, new_pos from shuffled")
def shuffle_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffle_rows(embeddings(spark, d), SEED)


@query("kmeans_sample", f"with {SHUFFLED} select vec_id, label from shuffled join embeddings using (vec_id) where new_pos < (select floor(0.2 * count(*)) from embeddings)")
def kmeans_sample(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return sampling.sample_rows(v, int(0.2 * v.count()), SEED).select("vec_id", "label")


def uniform_sql(seed: str, *columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 13))::bigint::double / 4503599627370496.0::double)"


@query("train_test_sample", f"select vec_id, 'train' as part from embeddings where {uniform_sql('42-train', 'vec_id')} < 0.3::double union all select vec_id, 'test' from embeddings where {uniform_sql('42-test', 'vec_id')} < 0.3::double")
def train_test_sample(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    part = lambda x: sampling.bernoulli_sample(v, 0.3, f"42-{x}").select("vec_id", F.lit(x).alias("part"))
    return part("train").unionByName(part("test"))


#: Draw k of a query is a row at a random place; the first 32 distinct ones.
START_SQL = f"""with rows_ as (select vec_id, row_number() over (order by vec_id) - 1 as place from embeddings), n as (select count(*) as n from embeddings),
draws as (select query_id, k, floor({uniform_sql(str(SEED), 'query_id', 'k')} * n)::bigint as place from (select vec_id as query_id from embeddings where vec_id % 100 = 0), n, (select unnest(range(4 * 32 + 64)) as k)),
distinct_ as (select query_id, place, min(k) as k from draws group by query_id, place),
first_ as (select query_id, place, row_number() over (partition by query_id order by k) - 1 as pos from distinct_)
select query_id, vec_id, pos::int as pos from first_ join rows_ using (place) where pos < 32"""


@query("start_points", START_SQL)
def start_points(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return sampling.start_points(asked(v), v, 32, SEED)


@query("sample_with_replacement", f"with rows_ as (select vec_id, row_number() over (order by vec_id) - 1 as place from embeddings), draws as (select k as draw, floor({uniform_sql(str(SEED), 'k')} * n)::bigint as place from (select unnest(range(300)) as k), (select count(*) as n from embeddings)) select draw, vec_id from draws join rows_ using (place)")
def sample_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_with_replacement(embeddings(spark, d), 300, SEED).select("draw", "vec_id")


@query("flatten_vectors", "select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, round(unnest(embedding)::double, 6) as x from embeddings")
def flatten_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select("vec_id", F.posexplode(V.as_double("embedding")).alias("pos", "x")).select("vec_id", "pos", r6("x"))


# Distances; the other vector is the label's mean, the scaled one (label + 1) times the vector


def with_own_center(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return v.join(label_centers(v), F.col("label") == F.col("center_id")).withColumn("scaled", F.expr("transform(cast(embedding as array<double>), x -> x * (label + 1))"))


OWN = f"{CENTERS}, own as (select vec_id, e, c, list_transform(e, lambda x: x * (label + 1)) as s from v join centers on label = center_id)"


@query("l2_distance", f"with {OWN} select vec_id, round({d2('s', 'e')}, 6) as distance from own")
def l2_distance(spark: SparkSession, d: str) -> DataFrame:
    return with_own_center(spark, d).select("vec_id", F.round(V.l2_squared("scaled", "embedding"), 6).alias("distance"))


@query("centroid_distance", f"with {OWN} select vec_id, round({d2('s', 'c')}, 6) as distance from own")
def centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    return with_own_center(spark, d).select("vec_id", F.round(V.l2_squared("scaled", "center"), 6).alias("distance"))


@query("inner_product", f"with {OWN} select vec_id, round({dot('s', 'c')}, 6) as similarity from own")
def inner_product(spark: SparkSession, d: str) -> DataFrame:
    return with_own_center(spark, d).select("vec_id", F.round(V.inner_product("scaled", "center"), 6).alias("similarity"))


@query("cosine_similarity", f"with {OWN} select vec_id, round({dot('s', 'c')} / (sqrt({dot('s', 's')}) * sqrt({dot('c', 'c')})), 6) as similarity from own")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    return with_own_center(spark, d).select("vec_id", F.round(V.cosine_similarity("scaled", "center"), 6).alias("similarity"))


# Plans


SIZES_SQL = "sizes as (select count(*) as n, max(len(embedding)) as dim from embeddings)"
NEED = "(n * dim * 4 + greatest(4 * n * deg * 4, n * dim * 4) + 10 * n * 4)"


@query("estimate_memory", f"with {SIZES_SQL} select deg::int as degree, {NEED}::bigint as bytes from sizes, (select unnest([16, 32, 64]) as deg)")
def estimate_memory(spark: SparkSession, d: str) -> DataFrame:
    n, dim = embeddings(spark, d).agg(F.count("*"), F.max(F.size("embedding"))).first()
    return spark.createDataFrame([(g, planning.estimate_memory(n, dim, g, 4)) for g in (16, 32, 64)], "degree int, bytes long")


@query("partition_plan", f"with {SIZES_SQL}, plan as (select part, n, 1.15::double * {NEED} as need, {NEED} / part::double as budget from sizes, (select 64 as deg), (select unnest([0.5, 1.0, 4.0, 16.0]) as part)) select part::double as budget_share, case when budget > need then 1 else floor((2 * need - 1) / budget) + 1 end::bigint as partitions, case when budget > need then n else floor(n * budget / need) end::bigint as size_limit from plan")
def partition_plan(spark: SparkSession, d: str) -> DataFrame:
    """For budgets of the estimated memory over 0.5, 1, 4 and 16."""
    n, dim = embeddings(spark, d).agg(F.count("*"), F.max(F.size("embedding"))).first()
    need = planning.estimate_memory(n, dim, 64, 4)
    return spark.createDataFrame([(p, *planning.plan_partitions(n, dim, 64, need / p / planning.GB, 2, 4)) for p in (0.5, 1.0, 4.0, 16.0)], "budget_share double, partitions long, size_limit long")


PLAN_SQL = """roots as (select n, floor(sqrt(n / 32.0::double))::bigint as down from (select count(*) as n from embeddings)),
growths as (select n, case when n / (down + 1.0::double) ^ 2 < 10 or abs(n / down::double ^ 2 - 32) < abs(n / (down + 1.0::double) ^ 2 - 32) then down else down + 1 end as g from roots),
layers as (select 0 as layer, n as size, 0::bigint as first_row, 0::bigint as first_translation, g from growths
  union all select 1, 32 * g, n, 0, g from growths union all select 2, 32, n + 32 * g, 32 * g, g from growths)"""


def plan_of(spark: SparkSession, d: str) -> planning.LayerPlan:
    return planning.layer_plan(embeddings(spark, d).count(), 3, 32, K)


@query("ggnn_layer_plan", f"with {PLAN_SQL} select layer::int as layer, size::bigint as size, first_row::bigint as first_row, first_translation::bigint as first_translation, g::bigint as growth from layers")
def layer_plan(spark: SparkSession, d: str) -> DataFrame:
    p = plan_of(spark, d)
    return spark.createDataFrame([(k, *x, p.growth) for k, x in enumerate(zip(p.sizes, p.offsets, p.translation_offsets))], "layer int, size long, first_row long, first_translation long, growth long")


@query("ggnn_index_size", f"with {PLAN_SQL}, t as (select sum(size) as rows_, sum(case when layer > 0 then size end) as up from layers) select (ceil(4 * rows_ * 10 / 8.0) * 8 + 2 * ceil(4 * up / 8.0) * 8 + 8)::bigint as bytes from t")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(planning.layered_index_size(plan_of(spark, d), K),)], "bytes long")


# k-means


@query("nearest_center", f"with {NEAR} select vec_id, center_id, round(dist, 6) as dist from near where rk = 1")
def nearest_center(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return kmeans.kmeans_assign(v, label_centers(v)).select("vec_id", "center_id", r6("dist"))


QUERIES["kmeans_assign"], ORACLE_SQL["kmeans_assign"] = nearest_center, ORACLE_SQL["nearest_center"]


@query("kmeans_lloyd_step", f"with {NEAR}, m as (select center_id, pos, avg(x) as x from (select center_id, unnest(e) as x, generate_subscripts(e, 1) as pos from near join v using (vec_id) where rk = 1) group by center_id, pos) select center_id, (pos - 1)::int as pos, round(x, 6) as x from m union all select center_id, (generate_subscripts(c, 1) - 1)::int, round(unnest(c), 6) from centers where center_id not in (select center_id from m)")
def kmeans_lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return kmeans.lloyd_step(v, label_centers(v)).select("center_id", F.posexplode("center").alias("pos", "x")).select("center_id", "pos", r6("x"))


@query("kmeans_residual", f"with {NEAR} select round(sum(dist), 6) as residual from near where rk = 1")
def kmeans_residual(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return kmeans.residual(v, label_centers(v)).select(r6("residual"))


def pp_init_sql(k: int) -> str:
    """k draws one after the other: the largest log(u) / (least distance to the rows drawn so far)."""
    steps = [f"p0 as (select vec_id, e from v order by md5(concat_ws(':', '{SEED}', 0, vec_id)), vec_id limit 1)", f"d0 as (select v.vec_id, v.e, {d2('v.e', 'p0.e')} as dist from v, p0)"]
    for i in range(1, k):
        u = f"((('0x' || substr(md5(concat_ws(':', '{SEED}', {i}, vec_id)), 1, 13))::bigint + 1)::double / 4503599627370497.0::double)"
        steps.append(f"p{i} as (select vec_id, e from d{i - 1} where dist > 0 order by ln({u}) / dist desc, vec_id limit 1)")
        steps.append(f"d{i} as (select d.vec_id, d.e, least(d.dist, {d2('d.e', f'p{i}.e')}) as dist from d{i - 1} d, p{i})")
    rows = " union all ".join(f"select {i}::bigint as center_id, e from p{i}" for i in range(k))
    return f"with {VEC}, {', '.join(steps)} select center_id, (generate_subscripts(e, 1) - 1)::int as pos, round(unnest(e), 6) as x from ({rows})"


@query("kmeans_pp_init", pp_init_sql(8))
def kmeans_pp_init(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.kmeans_pp_init(embeddings(spark, d), 8, SEED).select("center_id", F.posexplode("center").alias("pos", "x")).select("center_id", "pos", r6("x"))


@query("uniform_centers", f"with {VEC}, picked as (select e, row_number() over (order by md5(concat_ws(':', '{SEED}', vec_id)), vec_id) - 1 as center_id from v) select center_id, (generate_subscripts(e, 1) - 1)::int as pos, round(unnest(e), 6) as x from picked where center_id < 8")
def uniform_centers(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.uniform_centers(embeddings(spark, d), 8, SEED).select("center_id", F.posexplode("center").alias("pos", "x")).select("center_id", "pos", r6("x"))


@query("kmeans_pp_pick", f"with {NEAR}, w as (select vec_id, dist, sum(dist) over (order by vec_id) as running, sum(dist) over () as total from near where rk = 1) select vec_id from w where running >= 0.5::double * total order by vec_id limit 1")
def kmeans_pp_pick(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return kmeans.kmeans_pp_pick(kmeans.kmeans_assign(v, label_centers(v)).select("vec_id", "dist"), 0.5).select("vec_id")


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    return kmeans.kmeans_fit(embeddings(spark, d), 8, seed=SEED)


# Partitions


def rounded(assignment: DataFrame) -> DataFrame:
    return assignment.select("shard_id", "vec_id", F.col("round").cast("int").alias("round"), r6("dist"))


@query("direct_partition", "select (vec_id // 100)::int as shard_id, vec_id % 100 as local_id, vec_id from embeddings")
def direct_partition(spark: SparkSession, d: str) -> DataFrame:
    return partition.partition_range(embeddings(spark, d), 100)


@query("direct_partition_even", "with s as (select greatest(1, count(*) // 7) as size from embeddings) select least(vec_id // size, 6)::int as shard_id, vec_id - least(vec_id // size, 6) * size as local_id, vec_id from embeddings, s")
def direct_partition_even(spark: SparkSession, d: str) -> DataFrame:
    return partition.partition_even(embeddings(spark, d), 7)


@query("partition_knearest", f"with {NEAR} select center_id::int as shard_id, vec_id, rk::int as round, round(dist, 6) as dist from near where rk <= {COPIES}")
def partition_knearest(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return rounded(partition.partition_knearest(v, label_centers(v), COPIES))


@query("partition_selective", f"with {ASSIGNED} select shard_id, vec_id, round::int as round, round(dist, 6) as dist from assigned")
def partition_selective(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selective(spark, d))


#: Each vector's centres, nearest first, and its place in id order; one step of a recursion takes one vector.
IN_TURN = f"""{NEAR}, lists as materialized (select vec_id, list(center_id order by rk) as ids, list(dist order by rk) as dists, row_number() over (order by vec_id) as turn from near group by vec_id),
n_centers as materialized (select count(*) as m, max(center_id) + 1 as top from centers)"""


def tight_selective_sql(share: float, epsilon: float, copies: int) -> str:
    """Seats are given in id order; first each vector's nearest centre with a seat, then in a second pass more centres near it."""
    if copies != 2:
        raise ValueError("stated for one more shard at most")
    return f"""with recursive {IN_TURN}, lim as (select floor({share}::double * count(*))::bigint as l from v),
one as (
  select 0::bigint as turn, list_transform(range(top), lambda j: 0::bigint) as taken, null::bigint as vec_id, null::bigint as center_id, null::double as dist from n_centers
  union all
  select turn, list_transform(range(len(taken)), lambda j: taken[j + 1] + (pick is not null and ids[pick] = j)::int), vec_id, ids[pick], dists[pick] from (
    select x.turn, o.taken, x.vec_id, x.ids, x.dists, list_filter(range(1, len(x.ids) + 1), lambda k: o.taken[x.ids[k] + 1] < floor({partition.FIRST_ROUND}::double * l)::bigint + 1)[1] as pick
    from one o join lists x on x.turn = o.turn + 1, lim)
), first_round as (select vec_id, center_id, dist from one where center_id is not null),
stats as (select center_id, count(*) as taken, max(dist) as radius from first_round group by center_id),
seats as (select list(greatest(0, l - coalesce(taken, 0) + 1) order by c.center_id) as caps, list(coalesce(radius, 0.0) order by c.center_id) as radii from centers c left join stats using (center_id), lim),
two as (
  select 0::bigint as turn, list_transform(range(top), lambda j: 0::bigint) as taken, null::bigint as vec_id, null::bigint as center_id, null::double as dist from n_centers
  union all
  select turn, list_transform(range(len(taken)), lambda j: taken[j + 1] + (pick is not null and ids[pick] = j)::int), vec_id, ids[pick], dists[pick] from (
    select x.turn, o.taken, x.vec_id, x.ids, x.dists, list_filter(range(1, len(x.ids) + 1), lambda k: f.center_id is not null and x.ids[k] <> f.center_id and x.dists[k] < {epsilon}::double * f.dist and x.dists[k] < 2 * {epsilon}::double * radii[x.ids[k] + 1] and o.taken[x.ids[k] + 1] < caps[x.ids[k] + 1])[1] as pick
    from two o join lists x on x.turn = o.turn + 1 left join first_round f on f.vec_id = x.vec_id, seats)
), assigned as (
  select center_id, vec_id, 1 as round, dist from first_round union all select center_id, vec_id, 2, dist from two where center_id is not null
  union all select ids[1], vec_id, 0, dists[1] from lists where vec_id not in (select vec_id from first_round)
) select center_id::int as shard_id, vec_id, round::int as round, round(dist, 6) as dist from assigned"""


@query("partition_selective_tight", tight_selective_sql(TIGHT_SHARE, 1.2, COPIES))
def partition_selective_tight(spark: SparkSession, d: str) -> DataFrame:
    """With so few seats that vectors are turned away in both rounds."""
    v = embeddings(spark, d)
    return rounded(partition.partition_selective(v, label_centers(v), COPIES, seats(v, TIGHT_SHARE), 1.2))


@query("partition_nonselective", ORACLE_SQL["partition_knearest"])
def partition_nonselective(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return rounded(partition.partition_nonselective(v, label_centers(v), COPIES, v.count()))


#: For two copies: the first and the second centre with a seat, but the last but one and the last where it comes to that.
TIGHT_NONSELECTIVE_SQL = f"""with recursive {IN_TURN}, lim as (select floor(0.21::double * count(*))::bigint as l from v),
fold as (
  select 0::bigint as turn, list_transform(range(top), lambda j: 0::bigint) as taken, null::bigint as vec_id, null::bigint[] as ids, null::double[] as dists, null::bigint as a, null::bigint as b from n_centers
  union all
  select turn, list_transform(range(len(taken)), lambda j: taken[j + 1] + (ids[a] = j)::int + (ids[b] = j)::int), vec_id, ids, dists, a, b from (
    select *, coalesce(list_filter(free, lambda k: k > a)[1], len(ids)) as b from (
      select *, least(coalesce(free[1], len(ids) - 1), len(ids) - 1) as a from (
        select x.turn, f.taken, x.vec_id, x.ids, x.dists, list_filter(range(1, len(x.ids) + 1), lambda k: f.taken[x.ids[k] + 1] < l) as free
        from fold f join lists x on x.turn = f.turn + 1, lim)))
) select ids[a]::int as shard_id, vec_id, 1 as round, round(dists[a], 6) as dist from fold where vec_id is not null
union all select ids[b]::int, vec_id, 2, round(dists[b], 6) from fold where vec_id is not null"""


@query("partition_nonselective_tight", TIGHT_NONSELECTIVE_SQL)
def partition_nonselective_tight(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return rounded(partition.partition_nonselective(v, label_centers(v), COPIES, seats(v, 0.21)))


OVERLAP_SQL = f"""with recursive {NEAR}, fold as (
  select vec_id, center_id, dist, 1::bigint as rk, 1::bigint as kept, dist as total from near where rk = 1
  union all
  select n.vec_id, n.center_id, n.dist, n.rk, f.kept + 1, f.total + n.dist from fold f join near n on n.vec_id = f.vec_id and n.rk = f.rk + 1
  where f.kept < {COPIES} and n.dist <= {EPSILON}::double * f.total / f.kept
) select center_id::int as shard_id, vec_id, kept::int as round, round(dist, 6) as dist from fold"""


@query("partition_overlap_avg", OVERLAP_SQL)
def partition_overlap_avg(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return rounded(partition.partition_overlap(v, label_centers(v), COPIES, v.count(), EPSILON))


#: One step of the recursion is one centre of one vector.
TIGHT_OVERLAP_SQL = f"""with recursive {IN_TURN}, lim as materialized (select floor(0.18::double * count(*))::bigint as l, m from v, n_centers group by m),
fold as (
  select 0::bigint as step, list_transform(range(top), lambda j: 0::bigint) as taken, null::bigint as vec_id, null::bigint as center_id, null::double as dist, 0::bigint as kept, 0.0::double as total, 0::bigint as passed, 'infinity'::double as mean, false as now from n_centers
  union all
  select step, list_transform(range(len(taken)), lambda j: taken[j + 1] + (keep and center_id = j)::int), vec_id, center_id, dist, kept + keep::int,
    case when pass then total + dist else total end, passed + pass::int,
    case when not pass then mean when is_full then 'infinity'::double else (total + dist) / (passed + 1) end, keep
  from (
    select *, pass and not is_full as keep from (
      select *, taken[center_id + 1] >= l as is_full, kept < {COPIES} and dist <= {EPSILON}::double * mean as pass from (
        select f.step + 1 as step, f.taken, x.vec_id, x.ids[f.step % m + 1] as center_id, x.dists[f.step % m + 1] as dist, l,
          case when f.step % m = 0 then 0 else f.kept end as kept, case when f.step % m = 0 then 0.0::double else f.total end as total,
          case when f.step % m = 0 then 0 else f.passed end as passed, case when f.step % m = 0 then 'infinity'::double else f.mean end as mean
        from fold f, lim, lists x where x.turn = f.step // m + 1)))
) select center_id::int as shard_id, vec_id, kept::int as round, round(dist, 6) as dist from fold where now"""


@query("partition_overlap_tight", TIGHT_OVERLAP_SQL)
def partition_overlap_tight(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return rounded(partition.partition_overlap(v, label_centers(v), COPIES, seats(v, 0.18), EPSILON))


@query("partition_summary", f"with {ASSIGNED} select shard_id, count(*) as n, sum((round = 1)::int)::bigint as n_first, sum((round = 2)::int)::bigint as n_second, round(avg(dist), 6) as mean_dist from assigned group by shard_id")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    of = lambda r: F.sum((F.col("round") == r).cast("long"))
    return selective(spark, d).groupBy("shard_id").agg(F.count("*").alias("n"), of(1).alias("n_first"), of(2).alias("n_second"), F.round(F.avg("dist"), 6).alias("mean_dist"))


@query("partition_by_budget")
def partition_by_budget(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan: memory, sample, k-means, selective assignment, for a seventh of what one build needs."""
    v = embeddings(spark, d)
    n, dim = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    budget = planning.estimate_memory(n, dim, 64, 4) / 7 / planning.GB
    return rounded(partition.partition_by_budget(v, budget, 64, COPIES, epsilon=1.2, rate=0.5, seed=SEED)[0])


@query("ram_budget_partitions")
def ram_budget_partitions(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    n, dim = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return rounded(partition.partition_by_ram(v, planning.SLACK * planning.estimate_memory(n // 2, dim, 64, 4) / planning.GB, 64, COPIES, seed=SEED)[0])


@query("estimate_cluster_sizes", f"with {NEAR} select center_id::int as shard_id, round(count(*) / 0.3::double, 6) as estimate from near where rk <= {COPIES} and {uniform_sql('42-test', 'vec_id')} < 0.3::double group by center_id")
def estimate_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    return partition.estimate_cluster_sizes(sampling.bernoulli_sample(v, 0.3, "42-test"), label_centers(v), COPIES, 0.3).select("shard_id", r6("estimate"))


@query("replication_factor", f"with {ASSIGNED} select count(*) as n_rows, count(distinct vec_id) as n_vectors, round(count(*) / count(distinct vec_id)::double, 6) as replication from assigned")
def replication_factor(spark: SparkSession, d: str) -> DataFrame:
    return partition.replication_factor(selective(spark, d)).select("n_rows", "n_vectors", r6("replication"))


@query("shard_radius", f"with {ASSIGNED} select shard_id, round(max(dist), 6) as radius from assigned where round = 1 group by shard_id")
def shard_radius(spark: SparkSession, d: str) -> DataFrame:
    return partition.shard_radius(selective(spark, d)).select("shard_id", r6("radius"))


@query("unassigned_points", f"with {ASSIGNED} select vec_id from v where vec_id not in (select vec_id from assigned)")
def unassigned_points(spark: SparkSession, d: str) -> DataFrame:
    return partition.unassigned(embeddings(spark, d), selective(spark, d))


@query("local_ids", f"with {ASSIGNED} select shard_id, vec_id, local_id from placed")
def local_ids(spark: SparkSession, d: str) -> DataFrame:
    return selective(spark, d).select("shard_id", "vec_id", "local_id")


# Graphs


@query("shard_knn_graph", f"with {SHARD_GRAPH} select shard_id, src, pos::int as pos, dst from shard_graph")
def shard_knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return shard_edges(embeddings(spark, d), selective(spark, d))


@query("global_knn_graph", f"with {VEC} select src, pos::int as pos, dst from (select a.vec_id as src, b.vec_id as dst, row_number() over (partition by a.vec_id order by {d2('a.e', 'b.e')}, b.vec_id) as pos from v a join v b on a.vec_id <> b.vec_id) where pos <= {DEGREE}")
def global_knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_graph(embeddings(spark, d), DEGREE).drop("grp")


@query("nn_descent")
def nn_descent(spark: SparkSession, d: str) -> DataFrame:
    return graph.nn_descent(embeddings(spark, d), DEGREE, seed=SEED)


@query("vamana_graph")
def vamana_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.vamana_graph(embeddings(spark, d), 16, pool=32)


@query("hierarchical_graph", f"with {PLAN_SQL}, {VEC}, {SHUFFLED}, nodes as (select layer, vec_id, e from layers, shuffled join v using (vec_id) where new_pos < size) select layer::int as layer, src, pos::int as pos, dst from (select a.layer, a.vec_id as src, b.vec_id as dst, row_number() over (partition by a.layer, a.vec_id order by {d2('a.e', 'b.e')}, b.vec_id) as pos from nodes a join nodes b on a.layer = b.layer and a.vec_id <> b.vec_id) where pos <= {DEGREE}")
def hierarchical_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchical_graph(embeddings(spark, d), plan_of(spark, d), DEGREE, seed=SEED)


# Merging


@query("merge_graph", f"with {MERGED} select src, pos::int as pos, dst from merged")
def merge_graph(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)[2]


@query("merge_graph_variable", f"with {SHARD_GRAPH}, cut as ({cut_sql('shard_graph', 2 * DEGREE)}) select src, pos::int as pos, dst from cut")
def merge_graph_variable(spark: SparkSession, d: str) -> DataFrame:
    v, a = embeddings(spark, d), selective(spark, d)
    return merge.merge_graphs(merge.localise_edges(shard_edges(v, a), a), a, 2 * DEGREE, SEED, require_min=False)


@query("translate_graph", f"with {SHARD_GRAPH} select shard_id, src, pos::int as pos, dst from shard_graph")
def translate_graph(spark: SparkSession, d: str) -> DataFrame:
    v, a = embeddings(spark, d), selective(spark, d)
    return merge.translate_edges(merge.localise_edges(shard_edges(v, a), a), a)


@query("truncate_neighbors", f"with {SHARD_GRAPH}, cut as ({cut_sql('shard_graph', 4)}) select src, pos::int as pos, dst from cut")
def truncate_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return merge.truncate_edges(shard_edges(embeddings(spark, d), selective(spark, d)), 4, SEED)


@query("node_shard_map", f"with {ASSIGNED} select vec_id, shard_id, local_id from placed")
def node_shard_map(spark: SparkSession, d: str) -> DataFrame:
    return merge.node_shard_map(selective(spark, d))


@query("merge_stats", f"with {ASSIGNED} select max(vec_id) + 1 as n_nodes, count(*) as n_elements, count(distinct shard_id) as n_shards from assigned")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_stats(selective(spark, d))


@query("union_sort", f"with {MERGED} select src, dst from shard_graph union all select src, dst from merged")
def union_sort(spark: SparkSession, d: str) -> DataFrame:
    v, a, m = merged(spark, d)
    return merge.union_sort(shard_edges(v, a).select("src", "dst"), m.select("src", "dst"))


@query("concat_group_cut", f"with {MERGED}, both_ as (select src, dst from shard_graph union all select src, dst from merged), cut as ({cut_sql('both_', 6)}) select src, string_agg(dst::varchar, ',' order by pos) as neighbors from cut group by src")
def concat_group_cut(spark: SparkSession, d: str) -> DataFrame:
    v, a, m = merged(spark, d)
    return merge.concat_group_cut(shard_edges(v, a), m, 6, SEED).select("src", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@query("group_neighbors", f"with {MERGED} select src, string_agg(dst::varchar, ',' order by pos) as neighbors from merged group by src")
def group_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return merge.group_neighbors(merged(spark, d)[2]).select("src", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@query("degree_histogram", f"with {SHARD_GRAPH}, degs as (select src, count(distinct dst) as degree from shard_graph group by src) select degree, count(*) as n_nodes from degs group by degree")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return merge.degree_histogram(shard_edges(embeddings(spark, d), selective(spark, d)).select("src", "dst").distinct())


# Search


def found(results: DataFrame) -> DataFrame:
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", r6("distance"))


KNN_COLUMNS = "query_id, rank::int as rank, neighbor_id, round(distance, 6) as distance"


def truth(v: DataFrame, skip_self: bool = True) -> DataFrame:
    return knn.exact_knn(asked(v), v, K, query_id="query_id", skip_self=skip_self)


@query("exact_knn", f"with {KNN} select {KNN_COLUMNS} from truth")
def exact_knn(spark: SparkSession, d: str) -> DataFrame:
    return found(truth(embeddings(spark, d)))


def seeds_of(v: DataFrame, width: int) -> DataFrame:
    return sampling.start_points(asked(v), v, width, SEED)


@query("beam_search")
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    v, _, m = merged(spark, d)
    return found(search.beam_search(asked(v), v, m, seeds_of(v, 64), K, 64))


@query("beam_search_joins")
def beam_search_joins(spark: SparkSession, d: str) -> DataFrame:
    v, _, m = merged(spark, d)
    return found(search.beam_search_joins(asked(v), v, m, seeds_of(v, 16), K, 16))


@query("beam_search_full_pool", f"with {KNN_WITH_SELF} select {KNN_COLUMNS} from truth")
def beam_search_full_pool(spark: SparkSession, d: str) -> DataFrame:
    """With a pool for all rows the search is exact."""
    v, _, m = merged(spark, d)
    n = v.count()
    # as seeds_of(v, n), which are all rows
    return found(search.beam_search(asked(v), v, m, None, K, n))


def sharded(spark: SparkSession, d: str, width: int | None) -> DataFrame:
    v, a = embeddings(spark, d), selective(spark, d)
    return search.sharded_search(asked(v), v, shard_edges(v, a), a, K, width or v.count(), SEED)


@query("sharded_search_translated")
def sharded_search_translated(spark: SparkSession, d: str) -> DataFrame:
    return found(knn.merge_topk(sharded(spark, d, 32), K))


@query("sharded_search")
def sharded_search(spark: SparkSession, d: str) -> DataFrame:
    """Over contiguous shards: a global id is the local one plus the shard's first."""
    v = embeddings(spark, d)
    a = partition.partition_range(v, 250)
    return found(knn.merge_topk(search.sharded_search(asked(v), v, shard_edges(v, a), a, K, 32, SEED), K))


@query("sharded_search_full_pool", ORACLE_SQL["beam_search_full_pool"])
def sharded_search_full_pool(spark: SparkSession, d: str) -> DataFrame:
    return found(knn.merge_topk(sharded(spark, d, None), K))


@query("hierarchical_search")
def hierarchical_search(spark: SparkSession, d: str) -> DataFrame:
    v = embeddings(spark, d)
    layers = materialise(graph.hierarchical_graph(v, plan_of(spark, d), DEGREE, seed=SEED), "layers")
    top = layers.agg(F.max("layer")).first()[0]
    entry = layers.where(F.col("layer") == top).select(F.col("src").alias("vec_id")).distinct()
    seeds = sampling.start_points(asked(v), entry, 32, SEED)
    return found(search.hierarchical_search(asked(v), v, layers, seeds, K, 32))


SHARD_KNN = f"""{ASSIGNED}, by_shard as (
  select query_id, neighbor_id, distance from (
    select q.vec_id as query_id, a.vec_id as neighbor_id, {d2('q.e', 'b.e')} as distance, row_number() over (partition by a.shard_id, q.vec_id order by {d2('q.e', 'b.e')}, a.vec_id) as k
    from v q cross join placed a join v b on b.vec_id = a.vec_id where q.vec_id % 100 = 0) where k <= {K}
), once as (select query_id, neighbor_id, min(distance) as distance from by_shard group by query_id, neighbor_id)
"""


@query("merge_topk", f"with {SHARD_KNN} select {KNN_COLUMNS} from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from once) where rank <= {K}")
def merge_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact answers of every shard made one."""
    v, a = embeddings(spark, d), selective(spark, d)
    rows = a.select("shard_id", "vec_id").join(v, "vec_id")
    asked_each = a.select("shard_id").distinct().crossJoin(asked(v))
    each = knn.block_topk(asked_each, rows, K, group="shard_id", query_id="query_id", skip_self=False)
    return found(knn.merge_topk(each, K))


RECALL_SQL = f"""with {MERGED}, truth as (
  select * from (select q.vec_id as query_id, b.vec_id as neighbor_id, row_number() over (partition by q.vec_id order by {d2('q.e', 'b.e')}, b.vec_id) as rank from v q join v b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0) where rank <= {K}
) select round(avg(r), 6) as recall from (select query_id, 100.0::double * sum((m.dst is not null)::int) / count(*) as r from truth left join merged m on m.src = query_id and m.dst = neighbor_id group by query_id)"""


@query("recall_at_k", RECALL_SQL)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """How many true neighbours of the queries are among their neighbours in the merged graph."""
    v, _, m = merged(spark, d)
    results = m.where(F.col("src") % 100 == 0).select(F.col("src").alias("query_id"), F.col("dst").alias("neighbor_id"))
    return search.recall_at_k(results, truth(v), K).select(r6("recall"))


@query("beam_recall")
def beam_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of beam search over the merged graph for growing pools."""
    v, _, m = merged(spark, d)
    exact, graph = materialise(truth(v, skip_self=False), "truth"), search.handed(v, m)
    rows = [search.recall_at_k(search.beam_search(asked(v), v, m, seeds_of(v, w), K, w, graph=graph), exact, K).select(F.lit(w).alias("width"), r6("recall")) for w in (10, 20, 40, 64, 128)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("search_stats")
def search_stats(spark: SparkSession, d: str) -> DataFrame:
    v, _, m = merged(spark, d)
    return search.search_stats(search.beam_search(asked(v), v, m, seeds_of(v, 64), K, 64))


__all__ = ["ORACLE_SQL", "QUERIES"]

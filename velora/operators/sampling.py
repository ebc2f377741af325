"""Subsets, shuffles and samples whose randomness is a seeded digest, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.functions.ranking import md5_key


def subset_first_n(vectors: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """The first n rows, ids being row positions; an error if there are fewer."""
    rows = vectors.count()
    if n > rows:
        raise ValueError(f"{n} rows asked for, {rows} there")
    return vectors.where(F.col(id_col) < n)


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the digest."""
    return F.conv(F.substring(md5_key(seed, *columns), 1, 13), 16, 10).cast("double") / float(16**13)


def bernoulli_sample(df: DataFrame, rate: float, seed: int | str, id_col: str = "vec_id") -> DataFrame:
    """Each row with probability rate, without a shuffle."""
    return df.where(uniform(seed, id_col) < rate)


def sample_with_replacement(df: DataFrame, size: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """size rows, each drawn from all: draw (from 0) and the row's columns.

    Draw k is the row at place floor(u * n) in id order, u from the digest of (seed, k).
    """
    from velora.functions.ranking import grouped_rank

    n = df.count()
    draws = df.sparkSession.range(size if n else 0).select(F.col("id").alias("draw"), F.floor(uniform(seed, "id") * n).cast("long").alias("place"))
    placed = grouped_rank(df.withColumn("_all", F.lit(0)), ["_all"], id_col, "_place").drop("_all")
    return draws.join(placed, F.col("place") == F.col("_place") - 1).drop("place", "_place")


def shuffle_rows(df: DataFrame, seed: int, id_col: str = "vec_id") -> DataFrame:
    """vec_id, new_pos (from 0): a random permutation.

    The digest's first hex digits cut the rows into ranges of the order, as many as the
    rows ask for, which are ranked one by one after their counts are known.
    """
    from pyspark.sql import Window

    keyed = df.select(F.col(id_col).alias("vec_id"), md5_key(seed, id_col).alias("key")).withColumn("piece", F.substring("key", 1, 2 if df.count() < 1 << 26 else 4))
    counts = keyed.groupBy("piece").agg(F.count("*").alias("n"))
    # 256 rows, or 65,536 for very large tables
    before = counts.select("piece", F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("piece").orderBy("key", "vec_id"))
    return keyed.join(F.broadcast(before), "piece").select("vec_id", (own + F.col("before") - 1).cast("long").alias("new_pos"))


def sample_rows(df: DataFrame, size: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """size rows without replacement: the first of shuffle_rows()."""
    picked = shuffle_rows(df, seed, id_col).where(F.col("new_pos") < size).select(F.col("vec_id").alias("picked"))
    return df.join(picked, F.col(id_col) == F.col("picked"), "left_semi")


def draws_for(count: int) -> int:
    """Draws among 2 * count places or more that have count distinct ones among them but for a chance under 10**-15."""
    return 4 * count + 64


def start_points(queries: DataFrame, base: DataFrame, count: int, seed: int, *, query_id: str = "query_id", id_col: str = "vec_id", low: int | None = None, high: int | None = None) -> DataFrame:
    """query_id, vec_id, pos: count distinct random start rows per query, of ids in [low, high).

    Draw k of a query is the row at place floor(u * n) in id order, u from the digest
    of (seed, query, k); the first count distinct ones are taken, so that nothing but
    some rows per draw is made. Where count is over half of the rows, the rows are
    ordered by the digest of (seed, query, id) instead; where there are no more than
    count rows, all are start points.
    """
    from pyspark.sql import Window

    from velora.functions.ranking import grouped_rank

    rows = base.select(F.col(id_col).cast("long").alias("vec_id"))
    rows = rows if low is None else rows.where((F.col("vec_id") >= low) & (F.col("vec_id") < high))
    n = rows.count()
    ask = queries.select(F.col(query_id).cast("long").alias("query_id"))
    if 2 * count > n:
        # fewer than 2 * count rows for each query
        every = ask.join(F.broadcast(rows)).withColumn("key", md5_key(seed, "query_id", "vec_id"))
        order = Window.partitionBy("query_id").orderBy("key", "vec_id")
        return every.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < count).select("query_id", "vec_id", F.col("pos").cast("int").alias("pos"))
    rows = grouped_rank(rows.withColumn("all", F.lit(0)), ["all"], "vec_id", "place").select("vec_id", (F.col("place") - 1).alias("place"))
    draw = ask.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws_for(count) - 1))))
    draw = draw.withColumn("place", F.floor(uniform(seed, "query_id", "k") * n).cast("long")).groupBy("query_id", "place").agg(F.min("k").alias("k"))
    drawn = draw.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("k")) - 1).where(F.col("pos") < count)
    return drawn.join(rows, "place").select("query_id", "vec_id", F.col("pos").cast("int").alias("pos"))


def start_places(seed: int, query: int, n: int, count: int, scope: int | str = "") -> list[int]:
    """Places in id order of count distinct rows of n, drawn as start_points() does; scope tells samples for one query apart."""
    from hashlib import md5

    if count >= n:
        return list(range(n))
    digest = lambda k: md5(f"{seed}:{query}:{k}{scope}".encode()).hexdigest()
    if 2 * count > n:
        return sorted(range(n), key=lambda i: (digest(i), i))[:count]
    out: dict[int, None] = {}
    for k in range(draws_for(count)):
        # 13 hex digits
        out[int((int.from_bytes(md5(f"{seed}:{query}:{k}{scope}".encode()).digest()[:7]) >> 4) / 16**13 * n)] = None
        if len(out) == count:
            break
    return list(out)

"""Seeded orders that SQL engines share, and ranks in groups that may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed: int | str, *columns: Column | str) -> Column:
    """The hex digest of the seed and the columns, joined by colons: the same order in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


#: Rows that one piece of an order holds, about; and how many pieces there are at most.
PIECE_ROWS, PIECES = 1 << 18, 1024


def pieces_of(df: DataFrame, order: str, pieces: int | None = None) -> Column:
    """A row's piece (from 0): ranges of the order column between quantiles, one for PIECE_ROWS rows, from 64 to PIECES.

    A value that very many rows have is one piece, however the others lie.
    """
    marks = [k / PIECES for k in range(1, PIECES)]
    n, found = df.agg(F.count("*"), F.percentile_approx(order, marks, 20 * PIECES)).first()
    pieces = pieces or min(PIECES, max(64, n // PIECE_ROWS))
    chosen = [found[k * PIECES // pieces - 1] for k in range(1, pieces)] if found else []
    edges = sorted(set(chosen))
    return _bisect(F.col(order), edges, 0, len(edges))


def _bisect(value: Column, edges: list, low: int, high: int) -> Column:
    """How many of edges[low:high] are at most value, plus low."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value < F.lit(edges[middle]), _bisect(value, edges, low, middle)).otherwise(_bisect(value, edges, middle + 1, high))


def grouped_rank(df: DataFrame, keys: list[str], order: str, out: str, pieces: int | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in its group, by a numeric order column.

    The order is cut into ranges of about as many rows each; ranges are counted per
    group with partial aggregation, and each is ranked by itself. So no task sorts a
    whole group, however much of the table it holds. Rows with equal order values rank
    in no fixed order.
    """
    cut = df.withColumn("_piece", pieces_of(df, order, pieces))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n")).select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(counts, [*keys, "_piece"])
    own = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(order))
    return ranked.withColumn(out, own + F.col("_before")).drop("_piece", "_before")


def exclusive_prefix_sum(df: DataFrame, order: str, value: str, out: str, pieces: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before, in order of a numeric column of distinct values.

    The order is cut into ranges of about as many rows each, whose totals are
    aggregated first, so no task sees all rows.
    """
    cut = df.withColumn("_piece", pieces_of(df, order, pieces))
    # at most as many rows as pieces
    totals = cut.groupBy("_piece").agg(F.sum(value).alias("_s"))
    before = totals.select("_piece", F.coalesce(F.sum("_s").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(before), "_piece").withColumn(out, own + F.col("_before")).drop("_piece", "_before")

"""Toxicity: a character n-gram classifier with naive Bayes features.

Method. A text's features are its distinct character n-grams of 3 to 5 (A-Z
lower-cased), hashed to 2**20 columns. On the labelled sample, column f has the
log-count ratio r_f = log((p_f / |p|) / (q_f / |q|)) of its smoothed document
counts in toxic and other texts. Each present feature takes the value r_f, and an
L2-regularised logistic regression is fitted on these scaled features. The fit is of
the ``columns`` features whose ratio is best supported (|r| * sqrt(count), with a
count of ``min_count`` at least); columns=None and min_count=1 fit all 2**20. A score
is the logistic function of the sum over a text's distinct n-grams; whole texts
are scored, in the scan, without a shuffle.

The fit sees at most ``max_per_class`` labelled ids of either class, taken in the
order of a hash, and one row for each id (that with the least text hash); rows are
weighted so that the classes count as they do among all labelled training ids. The
sample's texts become feature lists on the executors, where they are counted too.
What reaches the driver is a count for each column and of each sampled row the columns
of the fit: at most 2 * max_per_class * columns numbers of 4 bytes.

Defined results: null and empty texts have no features and get the score of the
intercept. Labels that are null or neither 0 nor 1 are no labels. With labels of one
class every score is the share of toxic ones, smoothed by half a label; without any
label every score is 0 (less than 10**-200). Repeated rows get equal rows. Equal
support is decided by the column's number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import id_and_text, map_batches, release, texts_utf8, written
from velora.llm.linear import logistic, sigmoid

SIZES = (3, 4, 5)
BITS = 20
MAX_PER_CLASS = 2048
COLUMNS, MIN_COUNT = 1 << 14, 3


def ngrams(text: str) -> np.ndarray:
    """The columns of a text's n-grams, repeats included."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint32)
    out, h = [], codes * np.uint32(0x85EBCA6B)
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x9E3779B1) + codes[n - 1 :] * np.uint32(0x85EBCA6B)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    """weights of all columns, most of them zero; and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        columns = ngrams(text)
        columns = np.unique(columns[self.weights[columns] != 0])
        return float(sigmoid(np.array(self.intercept + self.weights[columns].sum(dtype=np.float64))))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _constant(toxic: int, others: int) -> Model:
    """The share of toxic labels for every text; 0 without labels."""
    share = (toxic + 0.5) / (toxic + others + 1)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))) if toxic + others else -500.0)


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = MAX_PER_CLASS, columns: int | None = COLUMNS, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("known"), label.alias("label")).where(F.col("known").isNotNull() & label.isin(0, 1) & ~is_held_out(F.col("known"))).groupBy("known").agg(F.max("label").alias("label"))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return _constant(n.get(1, 0), n.get(0, 0))
    order = F.xxhash64("known")
    sample = known.where("label = 1").orderBy(order, "known").limit(max_per_class).unionByName(known.where("label = 0").orderBy(order, "known").limit(max_per_class))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(ngrams(t.decode())).astype(np.int32) for t in texts_utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "columns"])

    # at most 2 * max_per_class rows: broadcast; an id's repeated rows are one
    texts = id_and_text(docs, id_col, text_col)
    texts = texts.join(F.broadcast(sample), texts.doc_id == sample.known).groupBy("known").agg(F.min(F.struct(F.xxhash64("text"), "label", "text")).alias("r"))
    rows = written(map_batches(texts.select("r.label", "r.text"), run, "label int, columns array<int>"), "toxicity-sample")
    have = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        release(rows)
        return _constant(n[1], n[0])
    counts = rows.select("label", F.explode("columns").alias("column")).groupBy("column").agg(F.sum("label").alias("p"), F.count("*").alias("n")).toArrow()
    p, total = (np.zeros(1 << BITS) for _ in range(2))
    p[counts["column"].to_numpy()], total[counts["column"].to_numpy()] = counts["p"].to_numpy(), counts["n"].to_numpy()
    ratio = np.log((p + 1.0) / (have[1] + 2)) - np.log((total - p + 1.0) / (have[0] + 2))
    support = np.where(total >= min_count, np.abs(ratio) * np.sqrt(total), 0.0)
    kept = np.argsort(-support, kind="stable")[: columns or len(support)]
    kept = np.sort(kept[support[kept] > 0])
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(x := sent.value[np.asarray(v.values)])[x >= 0] for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "columns"])

    train = map_batches(rows, placed, "label int, columns array<int>").toArrow()
    y = train["label"].to_numpy().astype(np.float64)
    lists = train["columns"].combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    # the fit doesn't depend on the order of rows
    ends = np.cumsum(sizes)
    by_text = sorted(range(len(y)), key=lambda k: (y[k], flat[ends[k] - sizes[k] : ends[k]].tobytes()))
    flat = np.concatenate([flat[ends[k] - sizes[k] : ends[k]] for k in by_text])
    y, sizes = y[by_text], sizes[by_text]
    weight = np.where(y == 1, n[1] / have[1], n[0] / have[0])
    theta, b = logistic(np.repeat(np.arange(len(y)), sizes), flat, ratio[kept][flat], y, weight, len(kept))
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = theta * ratio[kept]
    release(rows)
    return Model(weights, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.fromiter((sent.value.score(t.decode()) for t in texts_utf8(batch.column(1))), np.float64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

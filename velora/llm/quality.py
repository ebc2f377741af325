"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes.

Method. A logistic regression on surface features of the whole text (shares of
capitals, digits, marks and symbols, repeated and distinct words, lengths) gives
each document its evidence e, the probability of good quality. It is fitted on
at most ``max_train`` labelled documents, taken in the order of a hash of their
ids, one row for each id (that with the least text hash). Then grouped aggregation over all documents forms posteriors level by
level: the global rate g is the mean evidence; a host's rate shrinks towards g
as (sum e + strength * g) / (n + strength); a path's (a host's section) shrinks
towards its host's rate in the same way. A document's own evidence is left out
of its path's sums, so it never counts twice. The score moves the evidence's log
odds by ``site_weight`` times the path's log odds against the global ones, so
that a sparse site says nearly nothing. Documents whose score is at least
``min_score`` are kept.

Site sums are whole numbers of 10**-8, so that they, and a score at the threshold,
don't depend on the order of rows.

Scale. The site table has one row per host and path and is aggregated before
anything is joined, so a source that holds a third of all documents is a row per
task. Documents meet it in a join that Spark broadcasts if the table is small;
the evidence is computed in the scan, texts are not shuffled for it.

Defined results: null or empty texts have the features of no words. Null hosts
and paths are values of their own. Labels that are null or neither 0 nor 1 are
none; without labels of both classes all evidence is the share of good ones, or
one half without any. Repeated rows count as often as they stand there and get
equal rows. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.common import fresh_name, id_and_text, map_batches, release, texts_utf8, written
from velora.llm.linear import logistic, sigmoid

MAX_TRAIN = 8192
#: Evidence is summed in whole numbers of one part in so many.
UNITS = 10**8
FEATURES = ("log_words", "log_word_length", "upper", "digit", "full_stop", "bar", "exclaim", "symbol", "non_ascii", "line", "distinct", "repeat", "few_words")


def features(text: bytes) -> np.ndarray:
    """The features of a UTF-8 text, in the order of FEATURES."""
    size = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = max(len(words), 1)
    letters = max(counts[65:91].sum() + counts[97:123].sum(), 1)
    of = lambda chars: sum(counts[ord(c)] for c in chars)
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(len(text) / n),
            counts[65:91].sum() / letters,
            counts[48:58].sum() / size,
            of(".,") / n,
            of("|") / n,
            of("!") / n,
            of("#$%&*+=<>@^_`{}~\\") / n,
            counts[128:].sum() / size,
            counts[10] / n,
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            1.0 / n,
        ]
    )


@dataclass
class Model:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn the document classifier from a bounded sample of labelled documents."""
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("known"), label.alias("label")).where(F.col("known").isNotNull() & label.isin(0, 1)).groupBy("known").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("known"), "known").limit(max_train)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t).tolist() for t in texts_utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), *batch.columns[2:]], ["label", "features", "known", "text_hash"])

    # at most max_train rows: broadcast; and as many reach the driver, however often an id is repeated
    texts = id_and_text(docs, id_col, text_col)
    rows = map_batches(texts.join(F.broadcast(sample), texts.doc_id == sample.known).select("label", "text", "known", F.xxhash64("text")), run, "label int, features array<double>, known long, text_hash long")
    train = rows.groupBy("known").agg(F.min(F.struct("text_hash", "label", "features")).alias("r")).select("r.label", "r.features").toArrow()
    y = train["label"].to_numpy().astype(np.float64)
    size = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(size), np.ones(size), np.zeros(size), float(np.log(share / (1 - share))))
    x = np.array(train["features"].to_pylist())
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    weights, b = logistic(np.repeat(np.arange(len(y)), size), np.tile(np.arange(size), len(y)), z.ravel(), y, np.ones(len(y)), size, l2=1e-4)
    return Model(mean, scale, weights, b)


def evidence(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn the document classifier from a bounded sample of labelled documents."""
    label = F.col(label_col).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("known"), label.alias("label")).where(F.col("known").isNotNull() & label.isin(0, 1)).groupBy("known").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("known"), "known").limit(max_train)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t).tolist() for t in texts_utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), *batch.columns[2:]], ["label", "features", "known", "text_hash"])

    # at most max_train rows: broadcast; and as many reach the driver, however often an id is repeated
    texts = id_and_text(docs, id_col, text_col)
    rows = map_batches(texts.join(F.broadcast(sample), texts.doc_id == sample.known).select("label", "text", "known", F.xxhash64("text")), run, "label int, features array<double>, known long, text_hash long")
    train = rows.groupBy("known").agg(F.min(F.struct("text_hash", "label", "features")).alias("r")).select("r.label", "r.features").toArrow()
    y = train["label"].to_numpy().astype(np.float64)
    size = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(size), np.ones(size), np.zeros(size), float(np.log(share / (1 - share))))
    x = np.array(train["features"].to_pylist())
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    weights, b = logistic(np.repeat(np.arange(len(y)), size), np.tile(np.arange(size), len(y)), z.ravel(), y, np.ones(len(y)), size, l2=1e-4)
    return Model(mean, scale, weights, b)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """doc_id, host, path, evidence of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([features(t) for t in texts_utf8(batch.column(1))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sent.value.evidence(rows))], ["doc_id", "host", "path", "evidence"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    return map_batches(wanted, run, "doc_id long, host string, path string, evidence double")


def site_posteriors(rows: DataFrame, strength: float = 20.0) -> DataFrame:
    """host, path, n, total (sum of evidence), host_rate, global_rate of evidence() rows."""
    unit = F.round(F.col("evidence") * UNITS).cast("long")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(unit).alias("units"))
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("n_h"), F.sum("units").alias("u_h"))
    everything = paths.agg((F.sum("units") / F.lit(UNITS) / F.sum("n")).alias("global_rate"))
    # one row, so the nested-loop join with it is a projection
    rated = hosts.join(F.broadcast(everything)).select("h", "global_rate", ((F.col("u_h") / UNITS + strength * F.col("global_rate")) / (F.col("n_h") + strength)).alias("host_rate"))
    return paths.join(rated, F.col("host").eqNullSafe(F.col("h"))).select("host", "path", "n", (F.col("units") / UNITS).alias("total"), "host_rate", "global_rate")


def scores(own: np.ndarray, site: dict[str, np.ndarray], strength: float, site_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(path rate without the document itself, score) from documents' evidence and the rows of their sites."""

    def odds(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    path_rate = (site["total"] - own + strength * site["host_rate"]) / (site["n"] - 1 + strength)
    return path_rate, sigmoid(odds(own) + site_weight * (odds(path_rate) - odds(site["global_rate"])))


SITE = ("n", "total", "host_rate", "global_rate")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    min_score: float = 0.5,
    strength: float = 20.0,
    site_weight: float = 0.5,
    max_train: int = MAX_TRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, keep of every row."""
    model = fit(docs, labels, max_train=max_train, id_col=id_col, text_col=text_col)
    rows = written(evidence(docs, model, id_col, text_col, host_col, path_col), "quality-evidence")
    sites = site_posteriors(rows, strength).withColumnRenamed("host", "site_host").withColumnRenamed("path", "site_path")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left").select("doc_id", "evidence", *SITE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        site = {c: batch.column(2 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(SITE)}
        path_rate, score = scores(batch.column(1).to_numpy(), site, strength, site_weight)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(site["host_rate"]), pa.array(path_rate), pa.array(score), pa.array(score >= min_score)], ["doc_id", "evidence", "host_rate", "path_rate", "score", "keep"])

    return map_batches(joined, run, "doc_id long, evidence double, host_rate double, path_rate double, score double, keep boolean")


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    *,
    min_score: float = 0.5,
    strength: float = 20.0,
    site_weight: float = 0.5,
    max_train: int = MAX_TRAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """The documents, with all their columns, that classify() keeps.

    Texts are read twice and never shuffled where the site table can be
    broadcast: a document's score follows from its text and its site.
    """
    model = fit(docs, labels, max_train=max_train, id_col=id_col, text_col=text_col)
    rows = written(evidence(docs, model, id_col, text_col, host_col, path_col), "quality-evidence")
    sites = written(site_posteriors(rows, strength), "quality-sites")
    release(rows)
    names = {c: fresh_name(docs, f"site_{c}") for c in ("host", "path", *SITE)}
    renamed = sites.select(*(F.col(c).alias(n) for c, n in names.items()))
    on = F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col(names["host"])) & F.col(f"`{path_col}`").cast("string").eqNullSafe(F.col(names["path"]))
    joined = docs.join(renamed, on, "left").select(*(docs[f"`{c}`"] for c in docs.columns), *(names[c] for c in SITE))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value.evidence(np.array([features(t) for t in texts_utf8(batch.column(at))]))
        site = {c: batch.column(width + k).to_numpy(zero_copy_only=False) for k, c in enumerate(SITE)}
        return batch.select(list(range(width))).filter(pa.array(scores(own, site, strength, site_weight)[1] >= min_score))

    return map_batches(joined, run, docs.schema)

"""Operator 6, quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import trimmed
from tessella.llm.language import held_out

#: Statistics of a text, each transformed to be nearer to normal.
NAMES = ("words", "word_length", "upper", "digits", "marks", "symbols", "spaces", "lines", "line_copies", "distinct", "top_word", "pair_copies", "sentence", "entropy", "other_bytes", "longest_word")
#: Part of the covariance that is replaced by the diagonal of both classes' mean, and of the variances that is the mean variance.
SHRINK, RIDGE = 0.1, 0.02

_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _b in b".,;:!?'\"()-":
    _KIND[_b] = 3
for _b in b"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_b] = 4
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_KIND[128:] = 6
_PIECE = 1 << 22


def statistics(text: str | None) -> np.ndarray:
    """The NAMES of a whole text, all finite; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    by = np.zeros(256)
    for at in range(0, len(raw), _PIECE):
        by += np.bincount(np.frombuffer(raw[at : at + _PIECE], np.uint8), minlength=256)
    size = max(len(raw), 1)
    kinds = np.bincount(_KIND, weights=by, minlength=7) / size
    words = raw.lower().split()
    n = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = by[by > 0] / size
    share = lambda x: np.log((x * size + 0.5) / (size - x * size + 0.5))
    part = lambda k, of: np.log((k + 0.5) / (of - k + 0.5))
    stops = by[46] + by[33] + by[63]
    return np.array([
        np.log1p(len(words)), np.log((len(raw) - by[32]) / n + 1), share(kinds[1]), share(kinds[2]), share(kinds[3]), share(kinds[4]), share(kinds[5]), np.log((len(lines) + 1) / (n + 1)),
        part(len(lines) - len(set(lines)), len(lines)), np.log(len(counts) / n + 0.01), np.log(max(counts.values(), default=0) / n + 0.01), part(max(len(words) - 1 - pairs, 0), max(len(words) - 1, 0)),
        np.log((n + 1) / (stops + 1)), -(p * np.log(p)).sum() if len(raw) else 0.0, share(kinds[6]), np.log1p(max(map(len, counts), default=0)),
    ])


def with_statistics(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns with `stats`, an array of the NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, text_col).mapInArrow(trimmed(run), schema)


def train(stats: DataFrame) -> dict:
    """stats (stats, y) to the model. Each class's count, sums and products are summed in tasks, then over them; the two
    covariances are shrunk towards the diagonal of their mean and factored once.

    A class without rows gives a model that always answers the other; no rows at all, a score of 0.5.
    """
    d = len(NAMES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {y: np.zeros((d + 1, d + 1)) for y in (0, 1)}
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), np.vstack(batch["stats"].to_numpy())])
                for y in (0, 1):
                    at = x[(batch["y"] == y).to_numpy()]
                    sums[y] += at.T @ at
        for y, s in sums.items():
            yield pd.DataFrame({"y": y, "i": np.arange(s.size), "v": s.ravel()})

    # 2 (d + 1)^2 rows
    rows = stats.where("y in (0, 1)").mapInPandas(trimmed(moments), "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((2, d + 1, d + 1))
    for y, i, v in rows.itertuples(index=False):
        sums[int(y)].ravel()[int(i)] = v
    n = sums[:, 0, 0]
    if n.min() < 2:
        return {"constant": 0.5 if n.max() < 1 else float((n[1] + 0.5) / (n.sum() + 1))}
    mean = sums[:, 0, 1:] / n[:, None]
    cov = np.array([sums[y, 1:, 1:] / n[y] - np.outer(mean[y], mean[y]) for y in (0, 1)])
    both = np.diag(cov.mean(0))
    both = np.maximum(both, 1e-6) * (1 - RIDGE) + RIDGE * max(both.mean(), 1e-3)
    chol = np.array([np.linalg.cholesky((1 - SHRINK) * c + SHRINK * np.diag(both) + 1e-6 * np.eye(d)) for c in cov])
    return {"mean": mean, "inverse": np.array([np.linalg.inv(c) for c in chol]), "logdet": 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1), "prior": np.log(n / n.sum())}


def density_score(model: dict, x: np.ndarray) -> np.ndarray:
    """Chance of label 1: the logistic of the difference of the classes' log densities and log shares."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    log = [model["prior"][y] - 0.5 * model["logdet"][y] - 0.5 * (((x - model["mean"][y]) @ model["inverse"][y].T) ** 2).sum(1) for y in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def score(stats: DataFrame, model: dict, keep: tuple[str, ...]) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = density_score(sent.value, np.array(batch.column(len(keep)).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = T.StructType([*(stats.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return stats.select(*keep, "stats").mapInArrow(trimmed(run), schema)


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row an id that models may learn from; ids with both labels or none are left out."""
    ok = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    return ok.groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_most")).where("y = _most").select(F.col(id_col).alias("_id"), "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    known = labelled(labels, id_col, label_col)
    stats = with_statistics(docs.where(~held_out(id_col)), text_col, (id_col,))
    return train(stats.join(known, stats[id_col] == known["_id"]).select("stats", "y"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Only the text enters a score: rows with null ids, repeated ids or no label are scored alike; null texts count as
    empty and empty texts get the score of their statistics. Without usable labels every score is 0.5. An empty table
    gives no rows; other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    stats = with_statistics(docs.withColumn("held_out", held_out(id_col)), text_col, (id_col, "held_out"))
    return score(stats, model, (id_col, "held_out"))


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):  # what is copied at a time stays small
                batch = whole.slice(begin, 512)
                s = density_score(sent.value, np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, len(NAMES)))
                yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)

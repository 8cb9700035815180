"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics of its bytes, words and
lines. Class means and covariances come from sums over all labelled training
rows, added up on the executors. Covariances are shrunk towards the pooled one
and then towards a multiple of the identity; their Cholesky factors are computed
once, and a score is the logistic of the difference of the classes' log
densities (from Mahalanobis distances) plus log priors.

How far to shrink is chosen by cross-validation among the training rows: sums
are kept by fold, each fold is scored by the models of the other folds for every
pair of weights in ``WEIGHTS``, and the pair of least log loss is taken.

Scale: two passes over the text, none of it shuffled, and two over the labelled
rows' statistics; the driver sees 2 F (1 + d + d^2) sums for d features and F
folds, and one loss for each pair of weights, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkernels as T
from .scratch import packed, ship, stored, unpacked

FEATURES = ("bytes", "words", "word_length", "upper", "digit", "stop", "pause", "symbol", "beyond_ascii", "doubled",
            "all_caps", "no_letter", "distinct_words", "repeated_lines", "line_words", "long_words")
D = len(FEATURES)
FOLDS = 4
#: Shrinkage to choose from: (towards the pooled covariance, towards a multiple of the identity).
WEIGHTS = tuple((pooled, identity) for pooled in (0.0, 0.2, 0.5, 0.8, 1.0) for identity in (0.001, 0.01, 0.1, 0.3))


def _class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    return table


UPPER, LOWER, DIGIT = (_class(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
STOP, PAUSE, SYMBOL = (_class(x) for x in (".?", ",;:'\"()-", "!#$%&*+/<=>@[\\]^_`{|}~"))
HIGH = np.arange(256) >= 128


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, D) transformed statistics of a string column; all finite, zeros for empty texts."""
    at, raw = T.column_bytes(column)
    data, at = raw[at[0] : at[-1]], at - at[0]
    n = np.diff(at).astype(float)
    out = np.zeros((len(n), D))
    if not len(data):
        return out

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    upper, lower, symbol = UPPER[data], LOWER[data], SYMBOL[data]
    letters = per_row(upper | lower) + per_row(HIGH[data])
    same = np.zeros(len(data), bool)
    same[1:] = symbol[1:] & (data[1:] == data[:-1])
    per_byte = np.maximum(n, 1)
    out[:, 0] = np.log1p(n)
    out[:, 3] = np.sqrt(per_row(upper) / np.maximum(letters, 1))
    for k, flags in ((4, DIGIT[data]), (5, STOP[data]), (6, PAUSE[data]), (7, symbol), (8, HIGH[data]), (9, same)):
        out[:, k] = np.sqrt(per_row(flags) / per_byte)

    inside = T.byte_class(T.SPACES)
    word = inside[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    begin[at[:-1][at[:-1] < len(data)]] = word[at[:-1][at[:-1] < len(data)]]
    starts = np.flatnonzero(begin)
    hashes, word_at = T.word_hashes(column, inside)
    if len(starts) != len(hashes):  # a text so long that it was hashed in pieces: same words, same order
        starts = starts[: len(hashes)]
    words = np.diff(word_at).astype(float)
    row = np.repeat(np.arange(len(n)), np.diff(word_at))

    def span(flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each word."""
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(np.append(total[starts], total[-1]))

    some = np.maximum(words, 1)
    length, caps, small = span(word), span(upper), span(lower)
    alphabetic = caps + small + span(HIGH[data])
    count = lambda flags: np.bincount(row[flags], minlength=len(n))
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log1p(np.bincount(row, length, len(n)) / some)
    out[:, 10] = np.sqrt(count((caps > 1) & (small == 0)) / some)
    out[:, 11] = np.sqrt(count(alphabetic == 0) / some)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    out[:, 12] = np.log1p(np.bincount(row[order][new], minlength=len(n))) - np.log1p(words)
    lines, line_at = T.word_hashes(column, T.byte_class(b"\n"))
    per = np.diff(line_at)
    line_row = np.repeat(np.arange(len(n)), per)
    order = np.lexsort((lines, line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    out[:, 13] = np.sqrt(np.bincount(line_row[order][again], minlength=len(n)) / np.maximum(per, 1))
    out[:, 14] = np.log1p(words / np.maximum(per, 1))
    out[:, 15] = np.sqrt(count(length > 15) / some)
    return out


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list
    factors: list
    logs: list  # log prior minus half the log determinant, by class

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; a class without training rows has none, and 0.5 without any."""
        density = []
        for mean, factor, log in zip(self.means, self.factors, self.logs):
            if mean is None:
                density.append(np.full(len(x), -np.inf))
            else:
                z = np.linalg.solve(factor, (((x - self.centre) / self.scale) - mean).T)
                density.append(log - 0.5 * (z * z).sum(axis=0))
        if self.means[0] is None and self.means[1] is None:
            return np.full(len(x), 0.5)
        with np.errstate(over="ignore", invalid="ignore"):
            return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _describing(batches):
    for whole in batches:
        for batch in T.slices(whole, "_text"):
            x = statistics(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), T.list_array(np.full(len(x), D), pa.array(x.ravel().astype(np.float32)))], ["_id", "x"])


def _rows_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy().astype(float).reshape(-1, D)
    return x, np.asarray(batch.column("_label")), np.asarray(batch.column("_fold"))


def sums_of(x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(folds, classes, 1 + D + D^2): number of rows, sums of features and of their products."""
    total = np.zeros((FOLDS, 2, 1 + D + D * D))
    for f in range(FOLDS):
        for k in (0, 1):
            own = x[(label == k) & (fold == f)]
            total[f, k] = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    return total


def _sums(batches):
    total = np.zeros((FOLDS, 2, 1 + D + D * D))
    for batch in batches:
        total += sums_of(*_rows_of(batch))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size).astype(np.int32)), pa.array(total.ravel())], ["i", "v"])


def _losses(models: list[list[Model]]):
    """Summed log loss of each pair of weights, a row scored by the model that has not seen its fold."""

    def kernel(batches):
        total = np.zeros(len(models))
        for batch in batches:
            x, label, fold = _rows_of(batch)
            for f in range(FOLDS):
                own = fold == f
                for c, by_fold in enumerate(models):
                    total[c] += log_loss(by_fold[f].score(x[own]), label[own])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)).astype(np.int32)), pa.array(total)], ["i", "v"])

    return kernel


def log_loss(score: np.ndarray, label: np.ndarray) -> float:
    right = np.where(label == 1, score, 1 - score)
    return float(-np.log(np.clip(right, 1e-12, 1)).sum())


def fit(sums: np.ndarray, towards_pooled: float, towards_identity: float) -> Model:
    """The model of (classes, 1 + D + D^2) sums; without rows, one that scores 0.5."""
    n = sums[:, 0]
    if not n.sum():
        return Model(np.zeros(D), np.ones(D), [None, None], [None, None], [0.0, 0.0])
    first, second = sums[:, 1 : 1 + D], sums[:, 1 + D :].reshape(2, D, D)
    centre = first.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(np.einsum("kii->i", second) / n.sum() - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, scatter = [None, None], np.zeros((2, D, D))
    for k in (0, 1):
        if n[k]:
            mean = first[k] / n[k]
            cov = second[k] / n[k] - np.outer(mean, mean)
            means[k], scatter[k] = (mean - centre) / scale, cov / np.outer(scale, scale)
    pooled = np.tensordot(n / n.sum(), scatter, 1)
    factors, logs = [None, None], [0.0, 0.0]
    for k in (0, 1):
        if n[k]:
            cov = (1 - towards_pooled) * scatter[k] + towards_pooled * pooled
            level = max(np.trace(cov) / D, 1e-3)
            cov = (1 - towards_identity) * cov + towards_identity * level * np.eye(D)
            factors[k] = np.linalg.cholesky(cov)
            logs[k] = float(np.log(n[k] / n.sum()) - np.log(np.diag(factors[k])).sum())
    return Model(centre, scale, means, factors, logs)


def crc(id_col):
    """crc32 of the id as text; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def held_out(id_col):
    """Whether crc32 of the id as text, mod 5, is 0; a null id is the empty text."""
    return crc(id_col) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          weights: tuple[tuple[float, float], ...] = ()) -> Model:
    """Fit on the labelled rows that are not held out; null labels, and labels other than 0 and 1, are ignored.

    ``weights`` are the pairs (towards the pooled covariance, towards the identity)
    to choose from, by default those of ``WEIGHTS``; the first of equally good ones
    is taken, and a single pair is used without cross-validation.
    """
    weights = weights or WEIGHTS
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_l_id"), F.col(label_col).cast("int").alias("_label"))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # Statistics first: the join moves D numbers a row and no text. Stored, so that no task holds two Python workers.
    rows = rows.mapInArrow(_describing, f"_id {docs.schema[id_col].dataType.simpleString()}, x array<float>")
    known = stored(rows.join(marks, rows["_id"] == marks["_l_id"]).select("x", "_label", F.expr(f"cast(crc32(cast(cast(_id as string) as binary)) div 5 % {FOLDS} as int)").alias("_fold")), "statistics")

    def added(kernel, size: int) -> np.ndarray:
        total = np.zeros(size)
        for i, v in known.mapInArrow(kernel, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[i] = v
        return total

    sums = added(_sums, FOLDS * 2 * (1 + D + D * D)).reshape(FOLDS, 2, -1)
    every = sums.sum(axis=0)
    best = 0
    if len(weights) > 1 and every[:, 0].all():
        best = int(np.argmin(added(_losses([[fit(every - sums[f], *w) for f in range(FOLDS)] for w in weights]), len(weights))))
    return fit(every, *weights[best])


def _scoring(model: Model, place: int):
    def kernel(batches):
        for whole in batches:
            text = pc.struct_field(whole.column("row"), [place]).cast(pa.string())
            for batch in T.slices(pa.RecordBatch.from_arrays([whole.column("row"), text], ["row", "text"]), "text"):
                scores = model.score(statistics(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], ["row", "score"])

    return kernel


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): each row of ``docs`` as one struct, whatever its columns are called, and its score."""
    ship(docs.sparkSession)
    rows = packed(docs)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(_scoring(model, docs.columns.index(text_col)), schema)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of good quality, between 0 and 1.

    Null and empty texts score as an empty text does. Equal texts score equal. A
    column of ``docs`` that is called ``out`` too is replaced; others of any name
    pass through.
    """
    return unpacked(with_scores(docs, model, text_col), **{out: F.col("score")})


def good(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns, of any name."""
    return unpacked(with_scores(docs, model, text_col).where(F.col("score") >= cut))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Only the text is scored. Without labels every score is 0.5; with labels of
    one class only, that class is certain. Empty tables give empty results.
    """
    model = train(docs, labels, id_col, text_col, **options)
    return scored(docs.select(id_col, text_col), model, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

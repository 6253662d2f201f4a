"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a vector of ``FEATURES`` statistics of its whole text, transformed
to be nearer to normal. For each class, mean and covariance come from sums that Spark adds
up over all labelled rows; a class covariance is shrunk towards the diagonal of the pooled
one. The score is the probability of label 1 from the difference of the two Mahalanobis
log densities, each from a Cholesky factor computed once.

Defined results: null text counts as empty; an empty text has the vector of zeros and is
scored like any other. Labels that are null or not 0 or 1 teach nothing, neither do two
different labels of one document. Without labelled rows of both classes the score is the
share of label 1, without any it is 0.5. Documents without an id are scored, but not learned
from. Extra columns are left alone.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import must_be_free
from .words import BLANK, LINE, slices, words

FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digits", "stops", "symbols", "other_scripts",
            "distinct_words", "commonest_word", "repeated_next", "repeated_lines", "symbol_ends"]
#: Weight of the pooled diagonal in a class covariance, and what is added to each variance.
SHRINKAGE = 0.1
RIDGE = 1e-4
THRESHOLD = 0.3
SLICE_BYTES = 1 << 22

_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[ord(c) for c in ".,;:'\"()-?"]] = 3
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_KINDS[128:] = 5


def _repeats(found, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of different words and how often the commonest occurs."""
    row = np.repeat(np.arange(rows), np.diff(found.rows))
    order = np.lexsort((found.hashes, row))
    row, value = row[order], found.hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(row)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], run)
    return np.bincount(row[at], minlength=rows), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    rows = len(texts)
    found = words(texts, BLANK)
    size = np.diff(found.offsets)
    count = np.diff(found.rows)
    some, sized = np.maximum(count, 1), np.maximum(size, 1)
    kinds = _KINDS[found.data]
    of_kind = []
    for kind in range(1, 6):
        sums = np.zeros(len(kinds) + 1, np.int64)
        np.cumsum(kinds == kind, out=sums[1:])
        of_kind.append(np.diff(sums[found.offsets]) / sized)
    distinct, most = _repeats(found, rows)
    row = np.repeat(np.arange(rows), count)
    same = np.zeros(len(row), bool)
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (row[1:] == row[:-1])
    ends = np.isin(found.data[found.end - 1], np.flatnonzero(_KINDS == 4)) if len(row) else same
    lines = words(texts, LINE)
    n_lines = np.diff(lines.rows)
    different, _ = _repeats(lines, rows)
    length = np.bincount(row, found.end - found.start, rows) / some
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(length), *(np.sqrt(x) for x in of_kind), distinct / some,
        np.sqrt(most / some), np.sqrt(np.bincount(row, same, rows) / some),
        (n_lines - different) / np.maximum(n_lines, 1), np.sqrt(np.bincount(row, ends, rows) / some)]) * (size > 0)[:, None]


class Model(NamedTuple):
    """Means, inverse Cholesky factors and log constants of classes 0 and 1; ``share`` where a class is missing."""
    means: list
    factors: list
    constants: list
    share: float | None = None


def model_of(counts, sums, products, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """The model from each class's number of rows, sums and sums of products."""
    total = sum(counts)
    if not all(counts):
        return Model([], [], [], counts[1] / total if total else 0.5)
    means = [sums[k] / counts[k] for k in (0, 1)]
    scatter = [products[k] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(counts[k] * scatter[k] for k in (0, 1)) / total
    factors, constants = [], []
    for k in (0, 1):
        covariance = (1 - shrinkage) * scatter[k] + shrinkage * np.diag(np.diag(pooled)) + ridge * np.eye(len(pooled))
        lower = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(counts[k] / total) - np.log(np.diag(lower)).sum())
    return Model(means, factors, constants)


def scores(model: Model, vectors: np.ndarray) -> np.ndarray:
    """The probability of class 1."""
    if model.share is not None:
        return np.full(len(vectors), model.share)
    density = [c - 0.5 * (((vectors - m) @ f.T) ** 2).sum(axis=1)
               for m, f, c in zip(model.means, model.factors, model.constants)]
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``vector`` of every row."""
    def run(batches):
        for batch in slices(batches, SLICE_BYTES):
            found = statistics(batch.column(1))
            values = pa.array(found.ravel())
            offsets = pa.array(np.arange(0, len(values) + 1, len(FEATURES), dtype=np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["key", "vector"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, vector array<double>")


def fit(vectored: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """The model from all rows of ``vectored`` (see :func:`vectors`) that ``labels`` has one label of.

    The driver gets (number of features + 1) squared sums of each class, whatever the number of rows.
    """
    known = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key"))
             .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other"))
             .where(F.col("label") == F.col("other")).select("key", "label"))
    width = len(FEATURES) + 1

    def run(batches):
        sums = np.zeros((2, width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), np.stack(batch.column(0).to_numpy(zero_copy_only=False))])
            for k in (0, 1):
                sums[k] += x[kind == k].T @ x[kind == k]
        if sums.any():
            yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["place", "value"])

    rows = (vectored.join(known, "key").select("vector", "label").mapInArrow(run, "place long, value double")
            .groupBy("place").agg(F.sum("value")).collect())
    sums = np.zeros(2 * width * width)
    for place, value in rows:
        sums[place] = value
    sums = sums.reshape(2, width, width)
    return model_of(sums[:, 0, 0], sums[:, 0, 1:], sums[:, 1:, 1:], shrinkage, ridge)


def score(vectored: DataFrame, model: Model) -> DataFrame:
    """``vectored`` with ``score``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                yield pa.record_batch([*batch.columns, pa.array(scores(model, x))], ["key", "vector", "score"])

    kind = vectored.schema["key"].dataType.simpleString()
    return vectored.mapInArrow(run, f"key {kind}, vector array<double>, score double")


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score (``name`` must be free), in one pass over the texts and no shuffle."""
    must_be_free(docs, [name])
    place = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, SLICE_BYTES, text):
            found = scores(model, statistics(batch.column(place)))
            yield pa.record_batch([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(key: Column) -> Column:
    """Whether the contract keeps a document from training."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0

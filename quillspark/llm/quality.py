"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's score is the weighted sum of its distinct features: its lower-cased
words, scaled down where there are many, and a few properties of its shape
(repetition, symbols, word lengths) cut into steps, all hashed into one table.
The weights are shared by all grades; ordered thresholds t_1 < t_2 < ... turn the score into
P(grade >= k) = sigmoid(score - t_k), hence the expected grade and the tail
probability by which documents are selected.

Grades here: 0 toxic, 1 of low quality, 2 good. The model is fitted on at most
``PER_GRADE`` labelled documents of each grade, those of the least hash of
doc_id: a bounded sample, brought to the driver as feature numbers.

Defined cases: a null or empty text has only the features of an empty text;
labels that are null, repeated (the lowest grade counts) or of unknown documents
do no harm; without labels of two grades nothing can be learned and every
document is kept, with null probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spans
from .tables import text_of

PER_GRADE = 3000
GRADES = 3
TABLE_BITS = 18
SLICE_BYTES = 1 << 21
# features of fewer training documents than this have no weight: one document tells nothing about others
LEAST_DOCS = 2
# a feature's value counts in full where its share differs much between grades: z^2 / (z^2 + DOUBT)
DOUBT = 30.0
PENALTY = 2e-5
RATE = 0.05
TURNS = 600
TAIL = 0.55
# a word feature's value among n is WORD_SCALE / sqrt(n + WORD_SCALE^2), so that long texts do not drown in noise
WORD_SCALE = 2.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*+/<=>@\\^_`|~{}[]"]] = True


# shape properties, steps of each, and their places in the table
SHAPES, STEPS = 8, 17
SHAPE_SLOTS = (spans.mix(np.arange(7919, 7919 + SHAPES * STEPS, dtype=np.uint64))
               >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, features, documents, values): the distinct hashed features of slices of a string column."""
    data, offsets = spans.texts(column)
    for a, b in spans.slices(offsets, SLICE_BYTES):
        yield (a, *_slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))


def _slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = len(offsets) - 1
    data = spans.LOWER[data]
    starts, ends, first = spans.words(data, offsets)
    n = np.diff(first)
    owner = np.repeat(np.arange(docs), n)
    hashed = spans.hashes(data, starts, ends)
    size = 1 << TABLE_BITS
    slot = (hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    pair = np.unique(owner * size + slot)
    stripped = _without_marks(data, starts, ends)
    bare = np.unique(owner * size + (stripped >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    shape = _shape(data, starts, ends, owner, hashed, n, pair // size)
    every = np.unique(np.concatenate([pair, bare, shape]))
    value = np.where(np.isin(every % size, SHAPE_SLOTS), 1.0,
                     WORD_SCALE / np.sqrt(np.bincount(every // size, minlength=docs) + WORD_SCALE ** 2)[every // size])
    return every % size, every // size, value


def _without_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words without one mark at the end, so that "word," is also "word"."""
    last = ends - 1
    marked = np.zeros(len(starts), bool)
    marked[:] = np.isin(data[last], np.frombuffer(b".,;:!?", np.uint8)) & (last > starts)
    return spans.hashes(data, starts, ends - marked)


def _shape(data, starts, ends, owner, hashed, n, distinct_owner) -> np.ndarray:
    docs, size = len(n), 1 << TABLE_BITS
    some = np.maximum(n, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, docs) / some

    again = np.zeros(len(starts), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    lengths = ends - starts
    properties = [
        np.log2(some) / 16,  # words
        share(again),  # repeats
        np.bincount(distinct_owner, minlength=docs) / some,  # distinct
        share(SYMBOLS[data[ends - 1]]) if len(starts) else np.zeros(docs),  # symbol end
        share((lengths == 1) & SYMBOLS[data[starts]]) if len(starts) else np.zeros(docs),  # single
        share((data[starts] >= 48) & (data[starts] <= 57)) if len(starts) else np.zeros(docs),  # digits
        share(lengths > 20),  # long
        np.minimum(share(lengths) / 32, 1),  # mean length
    ]
    out = []
    for i, value in enumerate(properties):
        step = np.minimum((np.sqrt(np.clip(value, 0, 1)) * 16).astype(np.uint64), np.uint64(16))
        # a feature for every step up to the value, so that steps add up
        for at in range(STEPS):
            out.append(np.flatnonzero(step >= at) * size + SHAPE_SLOTS[i * STEPS + at])
    return np.concatenate(out)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def _relevance(slots: np.ndarray, owner: np.ndarray, grades: np.ndarray, size: int) -> np.ndarray:
    """How far each feature can be trusted, from 0 to below 1, by the sizes of the grades and not by a fixed count.

    z is the largest difference, in standard errors, between the documents of one
    grade that have the feature and those expected from its share of all grades.
    """
    docs = len(grades)
    share = np.bincount(slots, minlength=size) / docs
    most = np.zeros(size)
    for grade in range(GRADES):
        own = grades == grade
        k = int(own.sum())
        spread = k * (1 - k / docs) * share * (1 - share)
        off = np.bincount(slots[own[owner]], minlength=size) - k * share
        most = np.maximum(most, np.divide(off ** 2, spread, out=np.zeros(size), where=spread > 0))
    return (most / (most + DOUBT)).astype(np.float32)


def learn(slots: np.ndarray, owner: np.ndarray, values: np.ndarray, grades: np.ndarray,
          population: np.ndarray, turns: int = TURNS) -> Model:
    """Maximum likelihood with an L2 penalty by Adam over the whole sample.

    Values are scaled by the features' relevance, so that the penalty shrinks what few documents tell.
    Rows weigh so that the grades count as in the ``population``, not as in the sample.
    """
    docs, size, cuts = len(grades), 1 << TABLE_BITS, GRADES - 1
    common = np.bincount(slots, minlength=size) >= LEAST_DOCS
    keep = common[slots]
    used = np.flatnonzero(common)
    slots = (np.cumsum(common, dtype=np.int32) - 1)[slots[keep]]
    owner = owner[keep]
    relevance = _relevance(slots, owner, grades, len(used))
    values = values[keep]
    values *= relevance[slots]
    del keep
    share = np.bincount(grades, minlength=GRADES)
    weight = (population / np.maximum(share, 1))[grades]
    weight /= weight.sum()
    w = np.zeros(len(used))
    # thresholds are t_1 and positive steps, so that they stay ordered
    free = np.array([-1.0] + [0.0] * (cuts - 1))
    moments = [np.zeros(len(used) + cuts), np.zeros(len(used) + cuts)]
    for turn in range(1, turns + 1):
        thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        scores = np.bincount(owner, w[slots] * values, docs)
        edges = np.concatenate([np.full((docs, 1), np.inf), scores[:, None] - thresholds[None, :],
                                np.full((docs, 1), -np.inf)], axis=1)
        above = 1 / (1 + np.exp(-np.clip(edges, -60, 60)))
        row = np.arange(docs)
        high, low = above[row, grades], above[row, grades + 1]
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        by_score = -weight * (slope_high - slope_low) / chance
        by_threshold = np.zeros(cuts)
        for k in range(cuts):
            by_threshold[k] = (weight * ((grades == k + 1) * slope_high - (grades == k) * slope_low) / chance).sum()
        by_free = np.array([by_threshold[k:].sum() * (1 if k == 0 else np.exp(free[k])) for k in range(cuts)])
        gradient = np.concatenate([np.bincount(slots, by_score[owner] * values, len(used)) + PENALTY * w, by_free])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient ** 2
        step = RATE * (moments[0] / (1 - 0.9 ** turn)) / (np.sqrt(moments[1] / (1 - 0.999 ** turn)) + 1e-9)
        w -= step[:len(used)]
        free -= step[len(used):]
    weights = np.zeros(size)
    weights[used] = w * relevance
    return Model(weights, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, slots, owner, values in features(batch.column(1)):
            docs = int(owner[-1]) + 1
            counts = np.bincount(owner, minlength=docs)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.record_batch([batch.column(0).slice(first, docs),
                                   pa.ListArray.from_arrays(ends, pa.array(slots.astype(np.int32))),
                                   pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32)))],
                                  names=["grade", "slots", "values"])


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of every labelled document."""
    rated = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), rated.alias("grade"))
            .where("doc_id is not null and grade is not null")
            .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")))


def fit(docs: DataFrame, graded: DataFrame, per_grade: int = PER_GRADE) -> Model | None:
    """A model from at most ``per_grade`` documents of each grade; None if there are not two grades."""
    first = W.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (graded.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_grade)
              .select("doc_id", "grade"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sample = rows.join(F.broadcast(chosen), "doc_id")  # per_grade rows of each grade
    found = sample.select("grade", "text").mapInArrow(_feature_rows, "grade int, slots array<int>, values array<float>").toArrow()
    rated = found.column("grade").to_numpy().astype(np.int64) if found.num_rows else np.zeros(0, np.int64)
    if len(np.unique(rated)) < 2:
        return None
    population = np.zeros(GRADES)
    for row in graded.groupBy("grade").count().collect():  # one row per grade
        population[row["grade"]] = row["count"]
    lists = found.column("slots").combine_chunks()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    return learn(lists.flatten().to_numpy(), np.repeat(np.arange(len(rated), dtype=np.int32), counts),
                 found.column("values").combine_chunks().flatten().to_numpy(), rated, population)


def _score_rows(model: Model, tail: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, slots, owner, values in features(batch.column(1)):
                docs = int(owner[-1]) + 1
                tails = model.tails(np.bincount(owner, model.weights[slots] * values, docs))
                yield pa.record_batch([
                    batch.column(0).slice(first, docs), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]),
                    pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)), pa.array(tails[:, -1] >= tail)],
                    names=["doc_id", "expected_grade", "tail_probability", "grade", "kept"])
    return run


KIND = "doc_id long, expected_grade double, tail_probability double, grade int, kept boolean"


def score(docs: DataFrame, model: Model | None, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade), likeliest grade, and whether it is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"),
                           F.lit(None).cast("double").alias("tail_probability"),
                           F.lit(None).cast("int").alias("grade"), F.lit(True).alias("kept"))
    return rows.mapInArrow(_score_rows(model, tail), KIND)


def keep(docs: DataFrame, model: Model | None, tail: float = TAIL) -> DataFrame:
    """The documents whose tail probability is at least ``tail``, all columns, without a join."""
    if model is None:
        return docs
    at, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for first, slots, owner, values in features(batch.column(at)):
                here = int(owner[-1]) + 1
                good[first:first + here] = model.tails(
                    np.bincount(owner, model.weights[slots] * values, here))[:, -1] >= tail
            yield batch.filter(pa.array(good))

    return docs.select(*columns).mapInArrow(run, docs.schema)

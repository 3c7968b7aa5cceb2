"""N-gram language model as a weighted backoff automaton.

States are the n-grams of the training texts that can be a history, from the
empty one up. A state's arcs are the words seen after it; a word that was not is
found by failure arcs, each to the history without its first word. The smoothed
probabilities are

    P(w | h) = c(hw) / (c(h) + T) + T / (c(h) + T) * P(w | h'),   T = c(h)^beta

with one beta per order, chosen so that T adds up to the number of distinct
n-grams (Witten and Bell's count of successors, spread by c(h)). The empty
state's arcs are discounted counts; the discount is the chance of an unknown
word. Probabilities add up to one in every state.

Texts are packed into blocks of bounded size and written once, as word numbers.
Every block names its distinct n-grams; buckets of n-gram hashes add up the
counts and answer in the order of the question, so an answer is a number per
n-gram. A block then holds the part of the automaton that its texts can reach,
and traverses them from left to right, all its documents side by side. Counts
and model are never in one place, and all n-grams of all documents count.

Words are runs without ASCII white space, lower-cased in A-Z, known by 64-bit hashes.

Defined cases: null and empty texts have the end token only; rows with a null
doc_id are scored but not learned from; without training texts every token is
unknown, with probability one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import spans
from .tables import text_of

BLOCK_BYTES = 6 << 20
BUCKET_GRAMS = 4_000_000
END = np.uint64(0x5EED0E2D)
_ORDER_BITS = 3
_BINS = 64


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, count: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, count * width, codec="zstd", asbytes=True), kind)


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = spans.texts(batch.column(2))
        for a, b in spans.slices(offsets, BLOCK_BYTES):
            part = spans.LOWER[data[offsets[a]:offsets[b]]]
            starts, ends, first = spans.words(part, offsets[a:b + 1] - offsets[a])
            counts = np.diff(first) + 1
            hashed = np.full(len(starts) + b - a, END, np.uint64)
            inside = np.ones(len(hashed), bool)
            inside[np.cumsum(counts) - 1] = False
            hashed[inside] = spans.hashes(part, starts, ends)
            words, stream = np.unique(hashed, return_inverse=True)
            yield pa.record_batch([
                pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column(1).slice(a, b - a).to_pylist()], pa.list_(pa.bool_())),
                pa.array([counts.tolist()], pa.list_(pa.int32())),
                pa.array([words.tobytes()], pa.binary()),
                pa.array([pack(stream.astype(np.uint32))], pa.binary()),
                pa.array([len(stream)], pa.int64())],
                names=["doc_ids", "held", "counts", "words", "stream", "n_tokens"])


BLOCK = ("doc_ids array<long>, held array<boolean>, counts array<int>, words binary, stream binary, n_tokens long")


class Block:
    """The documents of one block as word numbers, and their distinct n-grams of all orders."""

    def __init__(self, row: dict, order: int):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.counts = np.array(row["counts"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.words = np.frombuffer(row["words"], np.uint64)
        self.stream = unpack(row["stream"], int(row["n_tokens"]), "<u4")
        train = np.repeat(~self.held, self.counts)
        place = np.arange(len(self.stream)) - np.repeat(self.starts, self.counts)
        hashed = self.words[self.stream]
        running = hashed
        self.grams, self.which, self.train = [], [], []  # per order: keys, gram that ends at a position or -1, counts
        for n in range(1, order + 1):
            if n > 1:
                running = spans.mix(np.concatenate([[np.uint64(0)], running[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
                                    + hashed)
            at = np.flatnonzero(place >= n - 1)
            keys, inverse = np.unique((running[at] << np.uint64(_ORDER_BITS)) | np.uint64(n), return_inverse=True)
            which = np.full(len(hashed), -1, np.int32)
            which[at] = inverse
            self.grams.append(keys)
            self.which.append(which)
            self.train.append(np.bincount(inverse, train[at], len(keys)).astype(np.int64))

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which n-grams are sent, and where each bucket begins in it."""
        keys = np.concatenate(self.grams)
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((spans.mix(keys) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _question_rows(order: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                keys, counts = np.concatenate(block.grams), np.concatenate(block.train)
                sent, begin = block.dealt(buckets)
                out: list[list] = [[], [], [], []]
                for i in range(buckets):
                    some = sent[begin[i]:begin[i + 1]]
                    if len(some):
                        for column, value in zip(out, (i, row["block"], keys[some].tobytes(), pack(counts[some]))):
                            column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(
                    out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["bucket", "block", "keys", "counts"])
    return run


def _answer_rows(order: int):
    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = [unpack(x, len(k), "<i8") for x, k in zip(table.column("counts").to_pylist(), keys)]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
        statistics = []
        for n in range(1, order + 1):
            own = totals[((distinct & np.uint64((1 << _ORDER_BITS) - 1)) == n) & (totals > 0)]
            bins = np.floor(np.log2(np.maximum(own, 1))).astype(np.int64)
            statistics += [int((own == 1).sum()), int((own == 2).sum())]
            statistics += np.bincount(bins, minlength=_BINS).tolist()
            statistics += np.bincount(bins, own, _BINS).astype(np.int64).tolist()
        ends = np.cumsum([len(k) for k in keys])
        answers = [pack(totals[which[e - len(k):e]]) for e, k in zip(ends, keys)]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                         "answers": pa.array(answers, pa.binary()),
                         "statistics": pa.array([statistics] + [None] * (len(keys) - 1), pa.list_(pa.int64()))})
    return run


@dataclass
class Smoothing:
    """What the whole corpus says about counts: a few numbers per order."""

    tokens: int
    distinct: int
    discount: float
    betas: list[float]

    @staticmethod
    def of(statistics: np.ndarray) -> "Smoothing":
        """``statistics`` has a row per order: singles, doubles, and by powers of two n-grams and their counts."""
        grams, counts = statistics[:, 2:2 + _BINS].astype(float), statistics[:, 2 + _BINS:].astype(float)
        tokens, distinct = int(counts[0].sum()), int(grams[0].sum())
        ones, twos = float(statistics[0, 0]), float(statistics[0, 1])
        discount = ones / (ones + 2 * twos) if ones else 0.5
        betas = []
        for n in range(1, len(statistics)):
            mean = counts[n - 1] / np.maximum(grams[n - 1], 1)
            low, high = 0.0, 1.0
            for _ in range(40):  # T grows with beta
                middle = (low + high) / 2
                if (grams[n - 1] * np.where(mean > 0, mean, 1.0) ** middle).sum() < grams[n].sum():
                    low = middle
                else:
                    high = middle
            betas.append((low + high) / 2)
        return Smoothing(tokens, distinct, min(max(discount, 1e-6), 1 - 1e-6), betas)


class Automaton:
    """The part of the automaton that a block's documents reach.

    Per history length k: ``arc[k][p]`` says whether the word at position p has
    an arc from the history of k words before it, ``weight[k][p]`` is that arc's
    log10 probability, ``fail[k][p]`` the weight of the failure arc out of the
    state of k words that ends at p. ``longest[p]`` is the longest state there.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], smoothing: Smoothing):
        order, size = len(counts), len(block.stream)
        at = [np.where(w >= 0, c[np.maximum(w, 0)], 0) if len(c) else np.zeros(size, np.int64)
              for w, c in zip(block.which, counts)]
        tokens = max(smoothing.tokens, 1)
        unknown = smoothing.discount * smoothing.distinct / tokens if smoothing.tokens else 1.0
        chance = np.where(at[0] > 0, (at[0] - smoothing.discount) / tokens, unknown)
        self.known = at[0]
        self.arc, self.weight, self.fail = [np.ones(size, bool)], [np.log10(chance)], [np.zeros(size)]
        self.longest = np.zeros(size, np.int64)
        for k in range(1, order):
            history = at[k - 1].astype(float)
            more = np.maximum(history, 1) ** smoothing.betas[k - 1]
            back = np.where(history > 0, more / (history + more), 1.0)
            before = np.concatenate([[1.0], back[:-1]])
            total = np.concatenate([[1.0], (history + more)[:-1]])
            chance = at[k] / total + before * chance
            self.arc.append(at[k] > 0)
            self.weight.append(np.log10(chance))
            self.fail.append(np.log10(back))
            self.longest[history > 0] = k

    def traverse(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each document, by one walk from left to right that carries its state."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        total, state = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        for step in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -step, side="left"))  # documents that have a word here
            at, now = begin[:m] + step, state[:m]
            left = np.ones(m, bool)
            for k in range(len(self.arc) - 1, 0, -1):
                here = left & (now >= k)
                found = here & self.arc[k][at]
                total[:m][found] += self.weight[k][at[found]]
                failed = here & ~found
                total[:m][failed] += self.fail[k][at[failed] - 1]
                left &= ~found
            total[:m][left] += self.weight[0][at[left]]
            state[:m] = np.minimum(self.longest[at], now + 1)
        out = np.empty_like(total)
        out[order] = total
        return out


def _score_rows(order: int, buckets: int, smoothing: Smoothing):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [],
                                "score": []}
        for row in blocks.to_pylist():
            block = Block(row, order)
            sent, begin = block.dealt(buckets)
            totals = np.empty(len(sent), np.int64)
            for i, raw in zip(answers.column("bucket").to_pylist(), answers.column("answers").to_pylist()):
                some = sent[begin[i]:begin[i + 1]]
                totals[some] = unpack(raw, len(some), "<i8")
            counts = np.split(totals, np.cumsum([len(g) for g in block.grams])[:-1])
            automaton = Automaton(block, counts, smoothing)
            known = automaton.known
            base = np.log10((known + 0.1) / (smoothing.tokens + 0.1 * (smoothing.distinct + 1)))
            out["doc_id"] += block.doc_ids
            out["held_out"] += block.held.tolist()
            out["n_tokens"] += block.counts.tolist()
            out["n_known"] += np.add.reduceat((known > 0).astype(np.int64), block.starts).tolist()
            out["base_score"] += np.add.reduceat(base, block.starts).tolist()
            out["score"] += automaton.traverse(block.starts, block.counts).tolist()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(
            out.items(), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
    return run


def score(docs: DataFrame, order: int = 2, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose crc32(doc_id as text) mod ``folds`` is not 0 are learned from.
    """
    if not 1 <= order < 1 << _ORDER_BITS:
        raise ValueError(f"order must be 1 to {(1 << _ORDER_BITS) - 1}")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_of(docs).alias("text"))
    blocks = written(rows.mapInArrow(_block_rows, BLOCK)
                     .withColumn("block", F.monotonically_increasing_id()))
    tokens = blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  math.ceil(tokens * order / BUCKET_GRAMS))
    questions = blocks.mapInArrow(_question_rows(order, buckets),
                                  "bucket int, block long, keys binary, counts binary")
    answers = written(questions.groupBy("bucket").applyInArrow(
        _answer_rows(order), "bucket int, block long, answers binary, statistics array<long>"))
    width = 2 + 2 * _BINS
    sums = {r["pos"]: r["n"] for r in (
        answers.where("statistics is not null").select(F.posexplode("statistics"))
        .groupBy("pos").agg(F.sum("col").alias("n")).collect())}  # order x width rows
    statistics = np.array([sums.get(i, 0) for i in range(order * width)]).reshape(order, width)
    smoothing = Smoothing.of(statistics)
    scored = (blocks.groupBy("block").cogroup(answers.select("bucket", "block", "answers").groupBy("block"))
              .applyInArrow(_score_rows(order, buckets, smoothing),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                            "score double"))
    return scored.withColumn("train_tokens", F.lit(smoothing.tokens).cast("long"))

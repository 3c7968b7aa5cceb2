"""Packing token pieces into sequences by a configuration linear program over their lengths.

The lengths (1 to the sequence length) are counted by Spark; the histogram has at
most that many rows, whatever the corpus. On it the linear program

    minimise sum x_c   subject to   sum_c a_cl x_c >= n_l   for every length l

over configurations c (multisets of lengths that fit a sequence) is solved by
multiplicative weights: lengths have prices, a knapsack dynamic program prices
the best configurations, those get weight, and the prices of what they cover
fall. The solution is rounded down; what is left of the histogram is packed by
best-fit over whole runs of equal lengths. Pieces are numbered per length and
each finds its sequence and offset in the plan, in tasks, without meeting others.

Defined cases: null text is empty (one piece with the end id); repeated rows are
packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .encoder import encoder
from .tables import dense_rank_slots, text_of

ROUNDS = 24
STEP = 0.5
# taken off every price, so that of equal configurations the one of fewer pieces wins
PER_PIECE = 1e-3
Plan = list[tuple[dict[int, int], int]]


def price(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best price of a configuration of at most each size, and its last length.

    ``prices[l]`` is the price of length l, zero where there is none. A last length of 0 means a gap.
    """
    size = len(prices) - 1
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(prices)
    worth = prices[lengths] - PER_PIECE
    for room in range(1, size + 1):
        n = int(np.searchsorted(lengths, room, side="right"))
        best[room] = best[room - 1]
        if n:
            value = best[room - lengths[:n]] + worth[:n]
            i = int(np.argmax(value))
            if value[i] > best[room]:
                best[room], last[room] = value[i], lengths[i]
    return best, last


def configuration(first: int, last: list[int], filled: list[int]) -> dict[int, int]:
    """The priced configuration that holds the length ``first``.

    ``filled[r]`` is the largest size up to r that does not end in a gap.
    """
    config, room = {first: 1}, filled[len(last) - 1 - first]
    while room > 0:
        length = last[room]
        config[length] = config.get(length, 0) + 1
        room = filled[room - length]
    return config


def solve(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Fractional configurations that cover the histogram ``counts`` (index: length), never more than that."""
    demand = counts.astype(float)
    left = demand.copy()
    solution: list[tuple[dict[int, int], float]] = []
    scale = np.arange(len(counts), dtype=float)
    for turn in range(rounds):
        open_lengths = np.flatnonzero(left >= 1)
        if not len(open_lengths):
            break
        # weight falls with the share that is covered; a price is the weight of a token times the length
        covered = 1 - left[open_lengths] / demand[open_lengths]
        prices = np.zeros(len(counts))
        prices[open_lengths] = scale[open_lengths] * np.exp(-step * covered)
        _, last = price(prices)
        filled = np.maximum.accumulate(np.where(last > 0, np.arange(len(last)), 0)).tolist()
        last = last.tolist()
        # dear lengths first: through each the best configuration under these prices
        for length in open_lengths[np.argsort(-prices[open_lengths], kind="stable")].tolist():
            if left[length] < 1:
                continue
            config = configuration(length, last, filled)
            times = min(left[i] / n for i, n in config.items())
            if times < 1 or sum(i * n for i, n in config.items()) < len(counts) - 2:
                continue
            share = times if turn == rounds - 1 else max(1.0, times * step)
            solution.append((config, share))
            for i, n in config.items():
                left[i] -= n * share
    return solution


def best_fit(left: np.ndarray) -> Plan:
    """Largest first, then the largest that still fits, over whole runs of equal lengths."""
    left, plan, size = left.copy(), [], len(left) - 1
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return plan
        config: dict[int, int] = {}
        room = size
        while room > 0:
            i = int(np.searchsorted(some, room, side="right")) - 1
            while i >= 0 and left[some[i]] <= config.get(int(some[i]), 0):
                i -= 1
            if i < 0:
                break
            length = int(some[i])
            take = min(room // length, int(left[length]) - config.get(length, 0))
            config[length] = config.get(length, 0) + take
            room -= take * length
        times = min(int(left[i]) // n for i, n in config.items())
        plan.append((config, times))
        for i, n in config.items():
            left[i] -= n * times


def make_plan(counts: np.ndarray) -> Plan:
    """Configurations with whole multiplicities that hold exactly the histogram."""
    plan: Plan = []
    left = counts.astype(np.int64).copy()
    for config, share in solve(counts):
        times = min(int(share), *[int(left[i]) // n for i, n in config.items()])
        if times:
            plan.append((config, times))
            for i, n in config.items():
                left[i] -= n * times
    return plan + best_fit(left)


class Places:
    """For the r-th piece of a length, its sequence and offset, by binary search in the plan.

    Its size is that of the plan: entries of configurations, not pieces.
    """

    def __init__(self, plan: Plan, size: int):
        rows, taken, sequence = [], np.zeros(size + 1, np.int64), 0
        for config, times in plan:
            offset = 0
            for length in sorted(config, reverse=True):
                for _ in range(config[length]):
                    rows.append((length, taken[length], sequence, offset))
                    taken[length] += times
                    offset += length
            sequence += times
        table = np.array(rows, np.int64).reshape(-1, 4)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.sequences = sequence
        self.begin = np.searchsorted(table[:, 0], np.arange(size + 2))
        self.first, self.sequence, self.offset = (np.ascontiguousarray(table[:, i]) for i in (1, 2, 3))

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.begin[lengths].copy(), self.begin[lengths + 1].copy()
        while True:  # the last entry of the length whose first rank is not beyond
            wide = high - low > 1
            if not wide.any():
                break
            middle = (low + high) // 2
            right = wide & (self.first[middle] <= ranks)
            low, high = np.where(right, middle, low), np.where(wide & ~right, middle, high)
        return self.sequence[low] + ranks - self.first[low], self.offset[low]


def _piece_rows(path: str, end_id: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, ids, counts in coder.documents(batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                at = 0
                names = batch.column(0).slice(first, len(counts)).to_pylist()
                for name, count in zip(names, counts.tolist()):
                    own = np.append(ids[at:at + count], np.uint32(end_id)).astype("<u4")
                    at += count
                    for piece, start in enumerate(range(0, len(own), size)):
                        part = own[start:start + size]
                        for column, value in zip(out, (name, piece, start, len(part), zlib.crc32(part))):
                            column.append(value)
                yield pa.record_batch(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of at most ``size`` tokens."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_piece_rows(tokenizer, end_id, size),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def histogram(cut: DataFrame, size: int) -> np.ndarray:
    """Pieces of each length; at most ``size`` rows come to the driver."""
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


def place(cut: DataFrame, plan: Plan, size: int) -> DataFrame:
    """``cut`` with sequence_id and offset."""
    places = Places(plan, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                  names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = dense_rank_slots(cut.withColumn("_mixed", F.xxhash64("doc_id", "piece")), "length", "_mixed", "_rank")
    columns = [c for c in cut.columns]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return (ranked.select(*columns, "_rank")
            .mapInArrow(run, f"{kind}, sequence_id long, offset long"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    cut = written(pieces(docs, tokenizer, end_id, size))
    return place(cut, make_plan(histogram(cut, size)), size)

"""Per-key state: bounded chat history and answers assembled from fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import params as P


def live_tail(rows: list[tuple], n: int, ttl_seconds: int) -> list[tuple]:
    """Newest ``n`` of (micros, order, content), cut at the last gap of ``ttl_seconds``.

    Only the newest ``n`` rows are needed to find that gap, so the state of a
    busy key stays at ``n`` rows.
    """
    rows = sorted(set(rows))[-n:]
    start = 0
    for i in range(1, len(rows)):
        if rows[i][0] - rows[i - 1][0] >= ttl_seconds * 1_000_000:
            start = i
    return rows[start:]


def bounded_history(msgs: DataFrame, key: str = "session_id", n: int = P.HISTORY_STORED,
                    ttl_seconds: int = P.HISTORY_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, order_no, content) stream -> the key's live history at each update.

    A history ends ``ttl_seconds`` after its last message: a later message
    starts a new one, and the state is dropped once the watermark is past it.
    Cache hits do not belong into ``msgs``; they leave the history untouched.
    """
    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            held = sorted(set(held) | set(zip(pdf["micros"].tolist(), pdf["order_no"].tolist(),
                                              pdf["content"].tolist())))[-n:]
        held = live_tail(held, n, ttl_seconds)
        expiry = held[-1][0] // 1000 + ttl_seconds * 1000
        if expiry > state.getCurrentWatermarkMs():
            state.update(tuple(list(c) for c in zip(*held)))
            state.setTimeoutTimestamp(expiry)
        elif state.exists:  # ended already: no timeout would ever come
            state.remove()
        yield pd.DataFrame({key: [k[0]], "size": [len(held)], "last_order": [held[-1][1]],
                            "history": ["\n".join(h[2] for h in held)]})

    timed = msgs.select(key, "ts", F.unix_micros("ts").alias("micros"), "order_no", "content")
    return (timed.withWatermark("ts", lateness).groupBy(key)
            .applyInPandasWithState(
                update, f"{key} string, size long, last_order long, history string",
                "micros array<long>, orders array<long>, contents array<string>",
                "update", GroupStateTimeout.EventTimeTimeout))


def assemble_answers(frames: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """(stream_id, seq, type, data) stream -> one row per answer once it is complete.

    An answer is complete when its ``done`` frame and all frames before it have
    arrived, in whatever order and micro-batches. An ``error`` frame ends it
    without a row. With ``patience_ms``, an answer for which nothing has come for
    so long is emitted with the frames that are there if ``done`` is among them,
    as the batch form does, and dropped otherwise. Give it to streams that run
    on: a timeout by the clock keeps an ``availableNow`` stream from ending.
    """
    def row(k: tuple, parts: dict, sources: str) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [k[0]], "sources": [sources],
                             "content": ["".join(parts[s] for s in sorted(parts))]})

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seqs, texts, sources, src_seq, done = state.get if state.exists else ([], [], "[]", -1, -1)
        parts, failed = dict(zip(seqs, texts)), False
        if state.hasTimedOut:
            state.remove()
            if done >= 0:
                yield row(k, parts, sources)
            return
        for pdf in batches:
            for seq, kind, data in zip(pdf["seq"], pdf["type"], pdf["data"]):
                if kind == "content":
                    parts[int(seq)] = data
                elif kind == "sources":
                    parts[int(seq)] = ""
                    if seq > src_seq:
                        sources, src_seq = data, int(seq)
                elif kind == "done":
                    done = int(seq)
                elif kind == "error":
                    failed = True
        if failed or (done >= 0 and len(parts) >= done):
            if state.exists:
                state.remove()
            if not failed:
                yield row(k, parts, sources)
        else:
            state.update((list(parts), list(parts.values()), sources, src_seq, done))
            if patience_ms:
                state.setTimeoutDuration(patience_ms)

    return frames.select("stream_id", "seq", "type", "data").groupBy("stream_id") \
        .applyInPandasWithState(
            update, "stream_id string, content string, sources string",
            "seqs array<long>, texts array<string>, sources string, src_seq long, done long",
            "append", GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout)

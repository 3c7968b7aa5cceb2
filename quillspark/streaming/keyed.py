"""Keyed state on RocksDB that grows by what a batch brings: ``transformWithState`` forms.

A fragment of an answer is one entry of a map state, and a message one entry of a list state,
so a batch writes its own rows and never what is held already. Event-time timers end a key's
state; nobody needs to give a patience, and a stream that has drained its input ends.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from . import stateful
from .stateful import live_tail

# The process that sets up a stream's state has no package on its path: classes travel whole.
for _module in (sys.modules[__name__], stateful):
    cloudpickle.register_pickle_by_value(_module)

#: An answer for which nothing has come for so long, by event time, is dropped.
ANSWER_ENDS_SECONDS = 3600
#: Python has no later times; frames that lie beyond count as of then.
LAST = datetime(9999, 12, 30, tzinfo=timezone.utc)


def _move_timer(handle: StatefulProcessorHandle, millis: int) -> None:
    for timer in list(handle.listTimers()):
        if timer != millis:
            handle.deleteTimer(timer)
    handle.registerTimer(millis)


def _joined(parts: dict) -> str:
    return "".join(parts[seq] for seq in sorted(parts))


class Answers(StatefulProcessor):
    """Fragments of one answer in a map state; the answer is emitted once it is whole."""

    def __init__(self, ends_after: int = ANSWER_ENDS_SECONDS):
        self.ends_after = ends_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", "data string")
        self.head = handle.getValueState("head", "held long, done long, sources string, src_seq long")

    def _held(self) -> dict:
        return {k[0]: v[0] for k, v in self.parts.iterator()}

    def _end(self) -> None:
        self.parts.clear()
        self.head.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _take(self, frames: Iterator[tuple]) -> list[tuple]:
        """Fragments (seq, type, data, millis) of one answer -> (content, sources) if it is whole now."""
        begun = self.head.exists()
        held, done, sources, src_seq = self.head.get() if begun else (0, -1, "[]", -1)
        fresh, failed, latest = {}, False, 0
        for seq, kind, data, millis in frames:
            latest = max(latest, millis or 0)
            if kind in ("content", "sources"):
                fresh[seq] = data if kind == "content" else ""
                if kind == "sources" and seq > src_seq:
                    sources, src_seq = data, seq
            elif kind == "done":
                done = seq
            elif kind == "error":
                failed = True
        held += sum(not self.parts.containsKey((seq,)) for seq in fresh) if begun else len(fresh)
        if failed or (done >= 0 and held >= done):
            # an answer that comes whole leaves nothing in the state
            found = [] if failed else [(_joined({**(self._held() if begun else {}), **fresh}), sources)]
            if begun:
                self._end()
            return found
        for seq, data in fresh.items():
            self.parts.updateValue((seq,), (data,))
        self.head.update((held, done, sources, src_seq))
        _move_timer(self.handle, max([latest + self.ends_after * 1000, *self.handle.listTimers()]))
        return []

    def _expire(self) -> list[tuple]:
        # as in the batch form, an answer that was done counts with the frames that are there
        done = self.head.exists() and self.head.get()[1] >= 0
        found = [(_joined(self._held()), self.head.get()[2])] if done else []
        self._end()
        return found

    def _frame(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        for content, sources in found:
            yield pd.DataFrame({"stream_id": [key[0]], "content": [content], "sources": [sources]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = ((int(seq), kind, data, int(millis)) for pdf in rows
                  for seq, kind, data, millis in zip(pdf["seq"], pdf["type"], pdf["data"], pdf["millis"]))
        return self._frame(key, self._take(frames))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frame(key, self._expire())

    def close(self) -> None:
        pass


class AnswerRows(Answers):
    """The same over plain rows, whose times may lie beyond the last one of pandas, in 2262."""

    def _row(self, key, found: list[tuple]) -> Iterator[Row]:
        for content, sources in found:
            yield Row(stream_id=key[0], content=content, sources=sources)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._row(key, self._take((r.seq, r.type, r.data, r.millis) for r in rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._row(key, self._expire())


def assemble_answers(frames: DataFrame, ts: str = "ts", lateness: str = "10 minutes",
                     ends_after: int = ANSWER_ENDS_SECONDS) -> DataFrame:
    """(stream_id, seq, type, data, ts) stream -> one row per answer once it is complete.

    An answer is complete when its ``done`` frame and all frames before it have arrived, in whatever
    order and micro-batches; an ``error`` frame ends it without a row. State ends ``ends_after`` seconds
    after an answer's last frame, once the watermark is past it.
    """
    at = F.when(F.col(ts) > F.lit(LAST), F.lit(LAST)).otherwise(F.col(ts))
    timed = frames.select("stream_id", "seq", "type", "data", at.alias("ts"),
                          F.unix_millis(at).alias("millis")).withWatermark("ts", lateness)
    return timed.groupBy("stream_id").transformWithState(
        AnswerRows(ends_after), "stream_id string, content string, sources string", "Append", "EventTime")


class History(StatefulProcessor):
    """The live history of a session in a list state of at most ``n`` messages."""

    def __init__(self, n: int, ttl_seconds: int):
        self.n, self.ttl = n, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "micros long, order_no long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for pdf in rows for r in zip(pdf["micros"].tolist(), pdf["order_no"].tolist(),
                                                pdf["content"].tolist())]
        before = [tuple(r) for r in self.messages.get()] if self.messages.exists() else []
        live = live_tail(before + fresh, self.n, self.ttl)
        added = sorted(set(fresh) - set(before))
        if sorted(before + added) == live:
            self.messages.appendList(added)
        else:  # some ended or went beyond the n newest
            self.messages.put(live)
        ends = live[-1][0] // 1000 + self.ttl * 1000
        if ends > timerValues.getCurrentWatermarkInMs():
            _move_timer(self.handle, ends)
        else:  # ended already
            self._end()
        yield pd.DataFrame({"key": [key[0]], "size": [len(live)], "last_order": [live[-1][1]],
                            "history": ["\n".join(m[2] for m in live)]})

    def _end(self) -> None:
        self.messages.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._end()
        return iter(())

    def close(self) -> None:
        pass


def bounded_history(msgs: DataFrame, key: str = "session_id", n: int = P.HISTORY_STORED,
                    ttl_seconds: int = P.HISTORY_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, order_no, content) stream -> the key's live history at each update.

    A history ends ``ttl_seconds`` after its last message: a later message starts a new one, and the
    state is dropped by a timer once the watermark is past it.
    """
    timed = (msgs.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("micros"), "order_no", "content")
             .withWatermark("ts", lateness))
    out = timed.groupBy("key").transformWithStateInPandas(
        History(n, ttl_seconds), "key string, size long, last_order long, history string", "Update", "EventTime")
    return out.withColumnRenamed("key", key)

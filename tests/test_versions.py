"""Tables with versions: full refresh, partition-wise merges, the compacted cache log, keyed state."""

import glob
import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import changes as C
from quillspark.operators import chunking as K
from quillspark.operators.partitioned import PartitionedState
from quillspark.sources import versions
from quillspark.streaming import cachelog, keyed

SCHEMA = "key STRING, value BIGINT, ts BIGINT"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted(tuple(r) for r in df.select("key", "value", "ts").collect())


def test_reader_during_a_refresh(spark, tmp_path):
    base = str(tmp_path / "t")
    assert versions.read(spark, base, SCHEMA).collect() == []
    versions.refresh(frame(spark, [("a", 1, 1)]), base)
    reader = versions.read(spark, base, SCHEMA)  # has chosen, has not read yet
    versions.refresh(frame(spark, [("b", 2, 2)]), base)
    assert listed(reader) == [("a", 1, 1)] and listed(versions.read(spark, base, SCHEMA)) == [("b", 2, 2)]
    versions.refresh(frame(spark, [("c", 3, 3)]), base)
    assert listed(versions.read(spark, base, SCHEMA, 1)) == [("b", 2, 2)]
    assert len(os.listdir(f"{base}/versions")) == 2  # the oldest is gone
    with pytest.raises(ValueError):
        versions.read(spark, base, SCHEMA, 9)


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    versions.refresh(frame(spark, [("a", 1, 1)]), base)
    broken = frame(spark, [("b", 2, 2)]).withColumn("value", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        versions.refresh(broken, base)
    assert listed(versions.read(spark, base, SCHEMA)) == [("a", 1, 1)]


# --- merges --------------------------------------------------------------

def plain_upsert(state, changes):
    held = {r[0]: r for r in state}
    for r in sorted(changes, key=lambda r: r[2]):
        if r[0] not in held or r[2] >= held[r[0]][2]:
            held[r[0]] = r
    return sorted(held.values())


def test_upsert_of_old_and_equal_versions(spark):
    state = [("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("d", 1, 5)]
    changes = [("a", 2, 6), ("b", 2, 4), ("c", 2, 5), ("e", 2, 1), ("e", 3, 2)]
    got = C.upsert(frame(spark, state), frame(spark, changes), ["key"], ["ts"])
    assert listed(got) == plain_upsert(state, changes)
    nulls = C.upsert(frame(spark, [(None, 1, 1)]), frame(spark, [(None, 2, 2)]), ["key"], ["ts"])
    assert [tuple(r) for r in nulls.collect()] == [(None, 2, 2)]


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/part=*/*.parquet")}


@pytest.fixture
def state(spark, tmp_path):
    s = PartitionedState(spark, str(tmp_path / "s"), SCHEMA, ("key",), ("ts",), 8)
    s.create(frame(spark, [(f"k{i}", i, 1) for i in range(200)]))
    return s


def test_untouched_files_stay(spark, state):
    before = files(state.path)
    touched = state.upsert(frame(spark, [("k7", 70, 2), ("k7", 71, 3), ("new", 0, 0)]))
    after = files(state.path)
    assert 1 <= len(touched) <= 2
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("part=")[1].split("/")[0] for f in before if f not in same} == {str(p) for p in touched}
    assert listed(state.read()) == plain_upsert([(f"k{i}", i, 1) for i in range(200)],
                                                [("k7", 70, 2), ("k7", 71, 3), ("new", 0, 0)])
    assert state.upsert(frame(spark, [])) == []


def test_delete_of_a_whole_partition(spark, state):
    part = state.stored().filter("key = 'k3'").first()["part"]
    gone = state.stored().filter(F.col("part") == part).select("key")
    want = listed(state.stored().filter(F.col("part") != part))
    gone = spark.createDataFrame(gone.collect(), "key STRING")
    assert state.delete(gone) == [part]
    assert listed(state.read()) == want and len(want) < 200


def test_routed_by_session(spark, tmp_path):
    s = PartitionedState(spark, str(tmp_path / "s"), "sid STRING, turn BIGINT, ts BIGINT", ("sid", "turn"), ("ts",), 4,
                         ("sid",))
    s.create(spark.createDataFrame([(f"s{i % 10}", i, 1) for i in range(100)], s.schema))
    assert len(s.delete(spark.createDataFrame([("s4",)], "sid STRING"))) == 1
    assert s.read().filter("sid = 's4'").count() == 0 and s.read().count() == 90
    with pytest.raises(ValueError):
        s.delete(spark.createDataFrame([(4,)], "turn BIGINT"))


# --- cache log -----------------------------------------------------------

def put(spark, base, batch, rows, every=3):
    cachelog.put_batch(frame(spark, rows), batch, base, SCHEMA, ["key"], ["ts"], every)


def test_log_is_compacted_and_bounded(spark, tmp_path):
    base = str(tmp_path / "log")
    assert cachelog.read(spark, base, SCHEMA, ["key"], ["ts"]).collect() == []
    everything = []
    for batch in range(11):
        rows = [(f"k{i % 7}", batch * 100 + i, batch * 10 + i % 5) for i in range(batch, batch + 6)]
        everything += rows
        put(spark, base, batch, rows)
        best = {}
        for r in everything:
            if r[0] not in best or r[2] >= best[r[0]][2]:
                best[r[0]] = r
        got = {r.key: r.ts for r in cachelog.read(spark, base, SCHEMA, ["key"], ["ts"]).collect()}
        assert got == {k: r[2] for k, r in best.items()}
    entry = versions.current(spark, base)
    assert entry["version"] == 2 and entry["through"] == 8
    assert spark.read.parquet(entry["folder"]).count() == 7  # the live keys
    assert len(os.listdir(f"{base}/snapshots")) == 2
    kept = sorted(int(d.split("=")[1]) for d in os.listdir(f"{base}/deltas") if "=" in d)
    assert kept == [6, 7, 8, 9, 10]  # what the last two versions need


def test_replayed_batches_of_the_log(spark, tmp_path):
    base = str(tmp_path / "log")
    for batch in range(3):
        put(spark, base, batch, [("a", batch, batch)])
    before = versions.entries(spark, base).count()
    put(spark, base, 2, [("a", 2, 2)])  # it is in the snapshot
    put(spark, base, 3, [("b", 9, 9)])
    put(spark, base, 3, [("b", 9, 9)])
    assert versions.entries(spark, base).count() == before
    assert listed(cachelog.read(spark, base, SCHEMA, ["key"], ["ts"])) == [("a", 2, 2), ("b", 9, 9)]


# --- keyed state ---------------------------------------------------------

class Held:
    """State in memory that counts what is written."""

    def __init__(self):
        self.rows, self.value, self.list, self.timers, self.written = {}, None, [], set(), 0

    def getMapState(self, *_):
        return self

    getValueState = getListState = getMapState

    def containsKey(self, k):
        return k in self.rows

    def updateValue(self, k, v):
        self.rows[k], self.written = v, self.written + 1

    def iterator(self):
        return iter(self.rows.items())

    def exists(self):
        return self.value is not None or bool(self.list)

    def get(self):
        return iter(self.list) if self.value is None else self.value

    def update(self, v):
        self.value = v

    def appendList(self, rows):
        self.list, self.written = self.list + list(rows), self.written + len(rows)

    def put(self, rows):
        self.list, self.written = list(rows), self.written + len(rows)

    def clear(self):
        self.rows, self.value, self.list = {}, None, []

    def listTimers(self):
        return iter(set(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def getCurrentWatermarkInMs(self):
        return 0


def test_fragments_are_written_once():
    held, answers = Held(), keyed.Answers(3600)
    answers.init(held)
    for seq in range(500):
        batch = pd.DataFrame({"seq": [seq], "type": ["content"], "data": [f"{seq} "], "millis": [seq * 1000]})
        assert list(answers.handleInputRows(("s",), iter([batch]), None)) == []
    assert held.written == 500 and held.timers == {499_000 + 3_600_000}
    done = pd.DataFrame({"seq": [500], "type": ["done"], "data": [""], "millis": [500_000]})
    out = list(answers.handleInputRows(("s",), iter([done]), None))
    assert out[0]["content"][0] == "".join(f"{i} " for i in range(500))
    assert held.rows == {} and held.value is None and held.timers == set()


def test_answers_end_by_event_time():
    for kinds, emitted in ((["content", "sources"], 0), (["content", "done"], 1), (["error"], 0)):
        held, answers = Held(), keyed.Answers(10)
        answers.init(held)
        batch = pd.DataFrame({"seq": [5, 7][:len(kinds)], "type": kinds, "data": ["x"] * len(kinds),
                              "millis": [1000] * len(kinds)})
        assert list(answers.handleInputRows(("s",), iter([batch]), None)) == []
        assert held.timers == (set() if kinds == ["error"] else {11_000})
        out = list(answers.handleExpiredTimer(("s",), None, None))
        assert len(out) == emitted and held.rows == {} and held.value is None and held.timers == set()


def test_history_writes_what_is_new():
    held, history = Held(), keyed.History(16, 3600)
    history.init(held)
    for i in range(16):
        batch = pd.DataFrame({"micros": [i * 1_000_000], "order_no": [i], "content": [str(i)]})
        list(history.handleInputRows(("s",), iter([batch]), held))
    assert held.written == 16 and held.timers == {15_000 + 3_600_000}
    list(history.handleExpiredTimer(("s",), None, None))
    assert held.list == [] and held.timers == set()


def test_state_is_dropped_in_a_stream(spark, tmp_path):
    """A stream without ``done`` keeps its state only until the watermark is past its end."""
    def frames(name, ts, *kinds):
        return [(name, {"sources": 0, "content": 1, "done": 2}[k], k, name[0], ts) for k in kinds]

    rows = [frames("open", datetime(2024, 1, 1), "sources", "content"),
            frames("later", datetime(2024, 1, 2), "sources", "content", "done"),
            frames("next", datetime(2024, 1, 3), "content", "sources", "done"),
            # its first fragments are forgotten by now, so this does not complete it
            frames("open", datetime(2024, 1, 3), "done")]
    path, schema = str(tmp_path / "in"), "stream_id STRING, seq BIGINT, type STRING, data STRING, ts TIMESTAMP"
    out = []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = (keyed.assemble_answers(stream, lateness="1 hour").writeStream
             .foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect()))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(x[:2] for x in out) == [("later", "l"), ("next", "n")]


def test_answers_of_far_times(spark, tmp_path):
    """Times after 2262, which pandas does not have, and after 9999, which Python does not have."""
    rows = [(name, seq, kind, f"{name}{seq}", seconds) for name, seconds in
            (("a", 60), ("b", 18_000_360_420), ("c", 400_000_000_000))
            for seq, kind in enumerate(("sources", "content", "content", "done"))]
    path, out = str(tmp_path / "in"), []
    df = spark.createDataFrame(rows, "stream_id STRING, seq BIGINT, type STRING, data STRING, s BIGINT").select(
        "stream_id", "seq", "type", "data", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(path)
    q = (keyed.assemble_answers(spark.readStream.schema(df.schema).parquet(path)).writeStream
         .foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect()))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(out) == [(x, f"{x}1{x}2", f"{x}0") for x in "abc"]


def test_whole_answers_leave_no_state():
    held, answers = Held(), keyed.Answers(3600)
    answers.init(held)
    batch = pd.DataFrame({"seq": [0, 1, 2], "type": ["sources", "content", "done"], "data": ["s", "x", ""],
                          "millis": [0, 0, 0]})
    out = list(answers.handleInputRows(("s",), iter([batch]), None))
    assert (out[0]["content"][0], out[0]["sources"][0]) == ("x", "s") and held.written == 0


# --- cutting -------------------------------------------------------------

def plain_cut(text, size, overlap, seps=("\n\n", "\n", " ", "")):
    """Pieces as strings, level by level, with the same rules."""
    at = next(i for i, s in enumerate(seps) if s == "" or s in text)
    sep = seps[at]
    if sep:
        parts = text.split(sep)
        pieces = [p for p in [parts[0], *[sep + p for p in parts[1:]]] if p]
    else:
        pieces = list(text)

    def merged(run):
        out, now = [], []
        for p in run:
            if now and sum(map(len, now)) + len(p) > size:
                out.append("".join(now))
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > size):
                    now = now[1:]
            now = [*now, p]
        return [*out, "".join(now)] if now else out

    out, run = [], []
    for p in pieces:
        if len(p) < size or not sep:
            run.append(p)
        else:
            out += merged(run) + plain_cut(p, size, overlap, seps[at + 1:])
            run = []
    return out + merged(run)


@pytest.mark.parametrize("seed", range(30))
def test_every_level_is_merged_on_its_own(seed):
    import random
    r = random.Random(seed)
    text = "".join(r.choice(["a", "bb", "ccc ", " ", "\n", "\n\n", "x" * r.randint(1, 90)]) for _ in range(400))
    for size, overlap in ((60, 15), (33, 0), (100, 40)):
        want = [c for c in (x.strip() for x in plain_cut(text, size, overlap)) if c]
        assert K.merge_pieces(text, size, overlap) == want


def test_short_texts_need_no_python(spark):
    rows = [(1, "  short \n"), (2, "  "), (3, ""), (4, None), (5, "word " * 600)]
    got = {}
    for r in K.recursive_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 1200, 200).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["short"], 5: K.merge_pieces("word " * 600, 1200, 200)}


FENCED = """intro
```python
# not a heading
~~~
```
  ## Indented
``` one line ``` # no
# Top
~~~
## inside
```
~~~
\t# After
```
# never closed"""


def test_fences_and_indents(spark):
    df = spark.createDataFrame([(1, FENCED)], "doc_id long, text string")
    got = [(r["path"], r["content"].split("\n")[0]) for r in K.sections(df).orderBy("section_no").collect()]
    assert got == [("通用正文", "intro"), ("Indented", "  ## Indented"), ("Top", "# Top"), ("After", "\t# After")]
    lines = [(1, i, x) for i, x in enumerate(FENCED.split("\n"))]
    want = ["通用正文"] * 5 + ["Indented"] * 2 + ["Top"] * 5 + ["After"] * 3
    for block in (1, 2, 3, 5, 4096):
        paths = K.heading_path(spark.createDataFrame(lines, "doc_id long, pos int, line string"), block)
        assert [r["path"] for r in paths.orderBy("pos").collect()] == want


def test_many_headings_are_linear(spark):
    import time
    text = "\n".join(f"{'#' * (i % 4 + 1)} heading {i}\ntext" for i in range(32_000))
    started = time.perf_counter()
    assert len(K.cut_sections(text)) == 32_000
    assert time.perf_counter() - started < 3

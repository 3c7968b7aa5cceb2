"""Streams give what the batch operators give."""

import time

import oracle
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dashboard as B
from quillspark.operators import history as H
from quillspark.operators import sparse as S
from quillspark.plans import catalog
from quillspark.plans import derived as D
from quillspark.plans.catalog import Tables
from quillspark.streaming import counters, sinks, stateful


@pytest.fixture(scope="module")
def t(spark, data_dir):
    return Tables(spark, data_dir)


def replay(df, tmp_path, parts=3, order=None):
    """Write a table as several files and read it as a stream, file by file."""
    path = str(tmp_path / "in")
    if order:
        for i, p in enumerate(df.orderBy(order).randomSplit([1.0] * parts, 7)):
            p.coalesce(1).write.mode("append").parquet(path)
    else:
        df.repartition(parts).write.parquet(path)
    return (df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
            .parquet(path))


def drain(stream, name, mode, tmp_path):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
         .start())
    q.awaitTermination(300)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def same(a, b):
    key = str
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_counters(spark, t, tmp_path):
    hit = F.col("event_type") == "view"
    out = drain(counters.running_counters(replay(t.events, tmp_path), hit), "c1", "complete", tmp_path)
    same(out, B.cache_hit_rate(t.events, hit).select("queries", "hits"))


def test_counts_by(spark, t, tmp_path):
    out = drain(counters.counts_by(replay(t.events, tmp_path), "event_type"), "c2", "complete", tmp_path)
    same(out, t.events.groupBy("event_type").count())


def test_daily_tokens(spark, t, tmp_path):
    m = D.msgs(t)
    out = drain(counters.daily_tokens(replay(m, tmp_path, 2), "30 days"), "c3", "update", tmp_path)
    last = out.groupBy("day", "role").agg(F.max("tokens").alias("n"))
    wide = last.groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.col("n"))), F.lit(0)).alias("i"),
        F.coalesce(F.sum(F.when(F.col("role") == "ai", F.col("n"))), F.lit(0)).alias("o"))
    same(wide, B.daily_tokens(m))


def test_repeated_uploads(spark, t, tmp_path):
    docs = D.docs(t).select("filename", "upload_time")
    out = drain(counters.drop_repeated_uploads(replay(docs, tmp_path)), "c4", "append", tmp_path)
    same(out.select("filename"), docs.select("filename").distinct())


def test_recent_repeats(spark, t, tmp_path):
    docs = D.docs(t).select("filename", F.col("upload_time").cast("timestamp").alias("ts"))
    twice = docs.unionByName(docs)
    out = drain(counters.drop_recent_repeats(replay(twice, tmp_path, 1), "ts", "30 days"), "c5",
                "append", tmp_path)
    same(out.select("filename"), docs.select("filename").distinct())


def test_assemble_answers(spark, t, tmp_path):
    frames = D.frames(t)
    out = drain(stateful.assemble_answers(replay(frames, tmp_path)), "c6", "append", tmp_path)
    same(out.select("stream_id", "content", "sources"), H.assemble_answers(frames))


def test_bounded_history(spark, t, tmp_path):
    e = t.events.select(F.col("user_id").cast("string").alias("session_id"),
                        F.col("ts").cast("timestamp").alias("ts"),
                        F.col("event_id").alias("order_no"), F.col("event_type").alias("content"))
    stream = stateful.bounded_history(replay(e, tmp_path), lateness="60 days")
    out = drain(stream, "c7", "update", tmp_path)
    # an update with the same newest message may only grow
    last = out.groupBy("session_id", "last_order").agg(F.max("size").alias("size")).groupBy(
        "session_id").agg(F.max_by("size", "last_order").alias("size"))
    want = (H.live_history(e, "session_id", "ts", "order_no").groupBy("session_id")
            .agg(F.count("*").alias("size")))
    same(last, want)


def test_live_tail():
    rows = [(0, 1, "a"), (10_000_000, 2, "b"), (3_700_000_000, 3, "c"), (3_700_000_001, 4, "d")]
    assert [r[2] for r in stateful.live_tail(rows, 16, 3600)] == ["c", "d"]
    exact = [(0, 1, "a"), (3_600_000_000, 2, "b")]
    assert [r[2] for r in stateful.live_tail(exact, 16, 3600)] == ["b"]
    near = [(0, 1, "a"), (3_599_999_999, 2, "b")]
    assert [r[2] for r in stateful.live_tail(near, 16, 3600)] == ["a", "b"]
    many = [(i, i, str(i)) for i in range(40)]
    assert len(stateful.live_tail(many, 16, 3600)) == 16


def test_ingest(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_bytes("# 第一章\n第12条 机动车应当按照规定的速度行驶。".encode("utf-8"))
    (files / "b.TXT").write_bytes("第九十一条 饮酒后驾驶机动车的，处暂扣驾驶证。".encode("gbk"))
    (files / "c.exe").write_bytes(b"not a document at all, skip it")
    (files / "d.md").write_bytes("short".encode())
    chunk_path, post_path = str(tmp_path / "chunks"), str(tmp_path / "postings")
    stream = sinks.file_stream(spark, str(files), 1)
    sinks.ingest(stream, chunk_path, post_path, str(tmp_path / "cp")).awaitTermination(300)
    chunks = sinks.read_batches(spark, chunk_path, sinks.CHUNK_ROWS)
    rows = {r["doc_id"].rsplit("/", 1)[-1]: r for r in chunks.collect()}
    assert set(rows) == {"a.txt", "b.TXT"}
    assert rows["a.txt"]["path"] == "第一章" and rows["a.txt"]["clause"] == "第12条"
    assert rows["b.TXT"]["clause"] == "第九十一条" and "饮酒" in rows["b.TXT"]["text"]
    posts = sinks.read_batches(spark, post_path, sinks.POSTING_ROWS)
    keyed = chunks.select(F.concat_ws("#", "doc_id", "section_no", "piece_no").alias("id"), "text")
    same(posts.select("term", "id", "tf"), S.build_postings(keyed).select("term", "id", "tf"))
    # nothing new: nothing changes
    sinks.ingest(sinks.file_stream(spark, str(files), 1), chunk_path, post_path,
                 str(tmp_path / "cp")).awaitTermination(300)
    assert sinks.read_batches(spark, chunk_path, sinks.CHUNK_ROWS).count() == 2


def test_cache_log(spark, t, tmp_path):
    puts = t.events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"),
                           "value", "ts")
    sinks.log_cache_puts(replay(puts, tmp_path), str(tmp_path / "log"),
                         str(tmp_path / "cp")).awaitTermination(300)
    got = sinks.read_cache(spark, str(tmp_path / "log"), "key STRING, value DOUBLE, ts TIMESTAMP_NTZ")
    from quillspark.operators.changes import last_change
    same(got.select("key", "ts", "value"), last_change(puts, ["key"], ["ts"]).select("key", "ts", "value"))


def test_lost_frames_and_errors(spark, tmp_path):
    """A gap is waited for and then passed over; an error ends an answer; nothing stays for ever."""
    first = spark.createDataFrame(
        [("gap", 0, "sources", "s"), ("gap", 1, "content", "a"), ("gap", 3, "done", ""),
         ("open", 0, "content", "x"), ("bad", 0, "content", "y"), ("bad", 1, "error", "no model"),
         ("whole", 0, "content", "z"), ("whole", 1, "done", "")],
        "stream_id string, seq long, type string, data string").coalesce(1)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    first.write.parquet(path)
    frames = spark.readStream.schema(first.schema).parquet(path)
    q = (stateful.assemble_answers(frames, 2000).writeStream
         .foreachBatch(lambda b, i: sinks.write_batch(b, out, i))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    got = []
    try:
        for _ in range(60):
            time.sleep(1)
            if q.lastProgress:
                rows = sinks.read_batches(spark, out, "stream_id string, content string, sources string")
                got = sorted((r["stream_id"], r["content"]) for r in rows.collect())
                left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
                if len(got) >= 2 and left == 0:
                    break
    finally:
        q.stop()
    assert got == [("gap", "a"), ("whole", "z")] and left == 0


@pytest.mark.parametrize("name", ["stream_assemble_answer", "stream_history_size"])
def test_keyed_streams_on_a_session_built_elsewhere(spark, data_dir, name):
    """Such a session has Spark's default state store, which can't hold map and list state."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    other.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    df = catalog.queries()[name](other, data_dir)
    assert oracle.compare(df, oracle.connect(data_dir), catalog.oracle_sql()[name]) is None

"""Inputs that must not end a job, and settings a cluster needs."""

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators import changes, hybrid
from quillspark.sources import io


def test_citations_of_any_number(spark):
    got = spark.range(1).select(X.cited_numbers(F.lit("[资料2] [资料99999999999] [资料１]")).alias("n")).first()["n"]
    assert got == [2, None, 1]


def test_zero_vector_has_no_cosine(spark):
    row = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert row["c"] is None


def test_undecodable_bytes_spare_the_other_files(spark):
    io.allow_gbk(spark)
    df = spark.createDataFrame([(1, bytearray("好".encode())), (2, bytearray(b"\xff\xff\xff")),
                                (3, bytearray("好".encode("gbk")))], "id int, content binary")
    got = {r["id"]: r["t"] for r in df.select("id", io.decode_text(F.col("content")).alias("t")).collect()}
    assert got[1] == got[3] == "好" and got[2] is not None


def test_fallback_rows_take_the_type_of_the_ids(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    candidates = spark.createDataFrame([(1, 0, "a#1")], "qid long, cand_idx int, id string")
    scores = spark.createDataFrame([(1, 0, 0.9)], "qid long, cand_idx int, score double")
    got = {r["qid"]: (r["id"], r["status"]) for r in hybrid.apply_rerank(queries, candidates, scores).collect()}
    assert got == {1: ("a#1", "ranked"), 2: (None, "fallback")}


def test_upsert_touches_only_changed_keys(spark):
    state = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "k int, v int, x string")
    change = spark.createDataFrame([(2, 3, "old"), (1, 2, "new"), (3, 1, "c"), (None, 2, "m")], state.schema)
    got = {r["k"]: r["x"] for r in changes.upsert(state, change, ["k"], ["v"]).collect()}
    assert got == {1: "new", 2: "b", 3: "c", None: "m"}


def test_no_local_folder_off_a_local_master(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_package_is_sent_once(spark):
    names = [f for f in spark.sparkContext._python_includes if "quillspark" in f]
    session.ship(spark)
    assert len(names) == 1 and [f for f in spark.sparkContext._python_includes if "quillspark" in f] == names

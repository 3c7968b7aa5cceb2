"""The Merkle manifest, hard negatives and the license scan against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses, merkle, negatives

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(hashes, arity):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def steps(levels, i, arity):
    for level in levels[:-1]:
        a = i // arity * arity
        yield "".join(level[a:i]), "".join(level[i + 1:a + arity])
        i //= arity


def plain_manifest(rows, arity=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {g: tree([leaf(r, r.text) for r in groups[g]], arity) for g in order}
    upper = tree([trees[g][-1][0] for g in order], arity) if order else []
    for at, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = [*steps(trees[g], i, arity), *steps(upper, at, arity)]
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            h = leaf(r, r.text.translate(SMALL) if bad and r.text is not None else r.text)
            for a, b in path:
                h = digest(a + h + b)
            yield (r.doc_id, trees[g][0][i], trees[g][-1][0], upper[-1][0], digest("".join(a + b for a, b in path)),
                   h, h == upper[-1][0])


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_manifest(documents):
    got = merkle.manifest(documents)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(got.collect()) == by_text(plain_manifest(documents.collect()))


@pytest.mark.parametrize("n, arity", [(1, 8), (8, 8), (9, 8), (65, 8), (82, 3)])
def test_manifest_sizes(spark, n, arity):
    rows = [(i * 7 % 1000, f"Text {i}", "en" if i % 3 else None, "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, arity=arity).collect()
    assert by_text(got) == by_text(plain_manifest(docs.collect(), arity))


def test_manifest_one_group_stays_even(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text", "'en' as lang", "'s' as source", "1 as n_chars")
    found = merkle.ranked(merkle.leaves(docs, "lang", "doc_id", merkle.FIELDS, F.lit(False), {}), ["key", "hash"])
    assert [r.lo for r in found.orderBy("key").collect()] == list(range(4000))
    assert found.select("n").distinct().collect() == [(4000,)]


def test_manifest_empty(documents):
    assert merkle.manifest(documents.where("false")).collect() == []


def plain_negatives(rows, k=5):
    """rows: (row, id, label, vector) of those that take part."""
    out = []
    for r, a, la, va in rows:
        if a % 100:
            continue
        scored = [(-sum(int(x) * int(y) for x, y in zip(va, v)), i, q, lb) for q, i, lb, v in rows
                  if q != r and len(v) == len(va)]
        for sp, p, _, _ in sorted(x for x in scored if x[3] == la)[:k]:
            inside = sorted(x for x in scored if x[3] != la and 80 * -sp <= 100 * -x[0] <= 100 * -sp)
            out += [(a, p, n, i, -sp, -s) for n, (s, i, _, _) in enumerate(inside[:k], 1)]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    heads = rng.standard_normal((6, 24))
    rows = []
    for i in range(700):
        v = heads[i % 6] + rng.standard_normal(24) * 0.4
        rows.append((i * 5, [float(x) for x in v], int(rng.integers(0, 4))))
    rows += [(100, rows[20][1], rows[20][2]), (100, rows[3][1], 1), (7, rows[20][1], 0)]  # repeated ids
    rows += [(5000 + 100 * i, [1.0, 2.0, float(i)], i % 2) for i in range(4)]  # another space
    rows += [(9000, None, 1), (9100, [1.0, None], 1), (9200, [float("nan")] * 24, 1), (9300, [float("inf")] * 24, 1),
             (9400, rows[0][1], None), (None, rows[0][1], 1), (9500, [], 2), (9600, [], 2), (9700, [1e30] * 24, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn(
        "row", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)


@pytest.mark.parametrize("row_block, anchor_block", [(1 << 14, 1 << 12), (60, 7)])
def test_hard_negatives(vectors, row_block, anchor_block):
    rows = negatives.integers(vectors, "vec_id", "embedding", F.col("label"), 256)
    got = negatives.mine(rows, F.col("id") % 100 == 0, row_block=row_block, anchor_block=anchor_block).collect()
    plain = [(r.row, r.id, r.label, r.v) for r in rows.collect()]
    assert len(plain) == 709 and sum(len(v) == 0 for *_, v in plain) == 2
    assert by_text(got) == by_text(plain_negatives(plain)) and len(got) > 100


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (5, 31, 64):
        v = np.floor(rng.standard_normal((50, dim)) * 256 + 40)
        for parts in negatives.LEVELS:
            if parts < dim:
                s = negatives.summaries(v, parts)
                middle, wide = s[:, :parts] @ s[:, :parts].T, s[:, parts:] @ s[:, parts:].T
                assert (np.abs(v @ v.T - middle) <= wide + 1e-6 * np.abs(v @ v.T).max()).all()


def test_summaries_prune():
    """With vectors whose energy lies in the means, few rows are scored exactly."""
    rng = np.random.default_rng(2)
    base = np.repeat(rng.standard_normal((4000, 16)), 4, axis=1) * 256
    v = np.floor(base + rng.standard_normal(base.shape) * 8).astype(np.int64)
    import pyarrow as pa
    summary = np.concatenate([negatives.summaries(v.astype(float), p) for p in negatives.LEVELS], axis=1)
    block = negatives.Block(pa.table({
        "row": np.arange(4000), "id": np.arange(4000), "label": np.zeros(4000, np.int64),
        "dim": np.full(4000, 64, np.int32), "v": pa.array(list(v)), "summary": pa.array(list(summary))}))
    asked = []
    own = block.scores
    block.scores = lambda rows, *x: (asked.append(len(rows)), own(rows, *x))[1]
    rows, scores = negatives.positives(block, 0, block, 5)
    want = v[1:] @ v[0]
    assert sorted(scores.tolist(), reverse=True) == np.sort(want)[::-1][:5].tolist() and asked[0] < 400


def test_no_vectors(vectors):
    rows = negatives.integers(vectors.where("false"), "vec_id", "embedding", F.col("label"), 256)
    assert negatives.mine(rows, F.col("id") % 100 == 0).collect() == []


def plain_scan(doc_id, text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    base, labels, score = [], set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
        base += [(i, label) for i in at]
    for label, notice, key in licenses.NOTICES:
        want, must = notice.split(), key.split()
        k = next(i for i in range(len(want)) if want[i:i + len(must)] == must)
        for start in range(-len(want), len(own)):
            same = [0 <= start + i < len(own) and own[start + i] == w for i, w in enumerate(want)]
            if all(same[k:k + len(must)]) and sum(same) >= 0.8 * len(want) - 1e-9:
                labels.add(label)
                score = max(score, sum(same) / len(want))
    base_labels = {label for _, label in base}
    return (doc_id, len(own), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), 1.0 if base else score)


LICENSED = [
    "Released Under the MIT-License. under the mit\nlicense, under the mit license",
    "Licensed under the Apache License, Version 2.0.", "licensed under cc by-nc 4.0 and CC BY SA 4.0; cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3",
    "licensed under a gnu general public license version 2", "the mit license", "licensed under the mit lizenz",
    "mit license under the", "é permission is hereby granted, at no cost, to any person obtaining a copy of this "
    "software and associated documentation files (the Software), to deal in the Software without restriction",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software with restriction",
    "under the", "license under the mit", "SPDX-License-Identifier: Apache-2.0",
]


def test_license_scan(spark, documents, plain):
    more = [(1000 + i, t, "en", "x") for i, t in enumerate(LICENSED)]
    docs = documents.select("doc_id", "text", "lang", "source", "size", "score").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = licenses.scan(docs).collect()
    want = [plain_scan(d, t) for d, t, *_ in [*plain, *more]]
    assert by_text((*r[:7], round(r.score, 9)) for r in got) == by_text((*w[:7], round(w[7], 9)) for w in want)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[1003] == "gpl-3" and labels[1009] == "mit" and labels[1010] == "" and labels[1013] == "apache-2"


def test_license_scan_real(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = licenses.scan(docs).collect()
    want = [plain_scan(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert by_text((*r[:7], round(r.score, 9)) for r in got) == by_text((*w[:7], round(w[7], 9)) for w in want)
    assert licenses.scan(docs.where("false")).collect() == []


def test_frequency_only_steers(spark):
    """Whatever the frequencies, the same places are found."""
    rng = np.random.default_rng(3)
    made = [licenses.Notice.of(*n) for n in licenses.NOTICES]
    known = licenses.vocabulary(made, licenses.PHRASES)
    data = [np.array([known.number[w] for w in n.words]) for n in made]
    for own in data:
        own[rng.random(len(own)) < 0.1] = -1
    own = np.concatenate(data)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    found = {tuple(map(tuple, zip(*[x.tolist() for x in licenses.Index(
        made, known, {w: int(n) for w, n in zip(known.words, rng.permutation(len(known.words)))}, 0.8
    ).verified(own, begin)]))) for _ in range(5)}
    assert len({tuple(sorted(x)) for x in found}) == 1 and len(found.pop()) > 5


@pytest.mark.parametrize("name", ["op11_merkle", "op12_hard_negatives"])
def test_oracle(spark, data_dir, name):
    import oracle

    from quillspark.llm import queries
    con = oracle.connect(data_dir)
    try:
        assert oracle.compare(queries.queries()[name](spark, data_dir), con, queries.oracle_sql()[name]) is None
    finally:
        con.close()

import collections
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import codes, language, mixing, ngram_lm, quality

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    raw = (text or "").encode()
    return [w.lower() for w in raw.split()] + [None]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_brute_force(documents, plain, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 2000)
    docs = [(d, tokens(t), d is None or zlib.crc32(str(d).encode()) % 10 == 0) for d, t, *_ in plain]
    counts = [collections.Counter() for _ in range(order)]
    for _, ws, held in docs:
        if not held:
            for n in range(order):
                counts[n].update(tuple(ws[i:i + n + 1]) for i in range(len(ws) - n))
    total, distinct = sum(counts[0].values()), len(counts[0])
    rows = []
    for c in counts:
        bins = [int(math.log2(v)) for v in c.values()]
        rows.append([sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()),
                     *np.bincount(bins, minlength=64), *np.bincount(bins, list(c.values()), 64).astype(int)])
    smooth = ngram_lm.Smoothing.of(np.array(rows))
    assert (smooth.tokens, smooth.distinct) == (total, distinct)

    def chance(history, word):
        if not history:
            c = counts[0][(word,)]
            return (c - smooth.discount) / total if c else smooth.discount * distinct / total
        c = counts[len(history) - 1][history]
        low = chance(history[1:], word)
        if not c:
            return low
        t = c ** smooth.betas[len(history) - 1]
        return counts[len(history)][(*history, word)] / (c + t) + t / (c + t) * low

    got = ngram_lm.score(documents, order).collect()
    want = sorted((str(d), held, len(ws), sum(counts[0][(w,)] > 0 for w in ws), total,
                   round(sum(math.log10((counts[0][(w,)] + .1) / (total + .1 * (distinct + 1))) for w in ws), 6),
                   round(sum(math.log10(chance(tuple(ws[max(0, i - order + 1):i]), w)) for i, w in enumerate(ws)), 6))
                  for d, ws, held in docs)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6),
                   round(r.score, 6)) for r in got)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)
    # probabilities add up to one in every state, the unknown word included
    words = [w for (w,) in counts[0]] + ["unknown"]
    for history in [(), *itertools.islice((h for c in counts[:-1] for h in c if h[-1] is not None), 20)]:
        assert sum(chance(history, w) for w in words) == pytest.approx(1)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 16)).round(3)
    vectors[50:90] = vectors[50]  # copies tie
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16),
           (1005, [float("inf")] * 16), (None, [1.0] * 16), (1020, [1.0, 2.0]), (3, vectors[3].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))
    got = codes.nearest(df, F.col("key") % 20 == 0, 20, vector_block=90, query_block=7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 400, 20))
    everyone = [*enumerate(vectors), (3, vectors[3])]
    for q, found in by.items():
        scores = [(-sum(float(a) * float(b) for a, b in zip(v, vectors[q])), i) for i, v in everyone if i != q]
        want = sorted((round(s, 9), i) for s, i in scores)[:20]
        assert [i for i, _ in found] == [i for _, i in want]
        assert [s for _, s in found] == pytest.approx([-s for s, _ in want])


def test_repeated_ids_and_few_candidates(spark):
    """Rows that share a vec_id with the query or each other are candidates; fewer than k give all."""
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.5, 0.0, 0.0]), (1, [0.5, 1.0, 0.0]), (1, [0.9, 0.0, 1.0]), (2, [-1.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = codes.nearest(df, F.col("key") == 0, 20).collect()
    want = []
    for i, (q, v) in enumerate(rows):
        if q == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i)
            want += [(0, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(got) == 8


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (64, 70):
        vectors, queries = rng.standard_normal((3000, dim)), rng.standard_normal((20, dim))
        centre = vectors.mean(axis=0)
        words, length, own = codes.encode(vectors, centre)
        assert words.shape == (3000, -(-dim // 64)) and words.dtype == np.uint64
        index = codes.Index(np.arange(3000), np.arange(3000), vectors, words, length, own, centre)
        off = []
        for q in queries:
            middle, slack = index.bounds(q)
            off.append(np.abs(middle - vectors @ q) / slack)
        assert (np.array(off) <= 1).mean() > 0.998 and np.median(off) < 0.4


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in b"abc"} | {b"ab", b"bc", b"abc"})
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces), 2))
    chance = {p: table[i] for i, p in enumerate(pieces)}
    words = [b"abcab", b"a", b"bcbc" * 40]

    def total(w):
        sums = [np.ones(2)] + [np.zeros(2)] * len(w)
        for e in range(1, len(w) + 1):
            sums[e] = sum((sums[e - n] * chance[w[e - n:e]] for n in (1, 2, 3) if n <= e and w[e - n:e] in chance),
                          np.zeros(2))
        return np.log(sums[-1])

    ends = np.cumsum([len(w) for w in words])
    got = language.forward(language.Lattice(pieces), np.frombuffer(b"".join(words), np.uint8),
                           ends - [len(w) for w in words], ends, table)
    assert np.allclose(got, [total(w) for w in words])


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def test_expected_counts_over_all_segmentations():
    """The E step against an enumeration, with pieces of lengths that are not consecutive."""
    pieces = sorted({bytes([b]) for b in b"abc"} | {b"abca", b"bc", b"bcabc"})
    assert language.Lattice(pieces).lengths == [1, 2, 4, 5]
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces), 3)) + 0.05
    words = [b"abcabc", b"bcabcbc", b"a", b"cab"]
    weights = rng.integers(0, 5, (len(words), 3)).astype(float)
    want = np.zeros(table.shape)
    for w, weight in zip(words, weights):
        ways = list(segmentations(w, set(pieces)))
        chance = np.array([np.prod([table[pieces.index(p)] for p in way], axis=0) for way in ways])
        for way, share in zip(ways, chance / chance.sum(axis=0)):
            for p in way:
                want[pieces.index(p)] += share * weight
    ends = np.cumsum([len(w) for w in words])
    got = language.expected_counts(language.Lattice(pieces), np.frombuffer(b"".join(words), np.uint8),
                                   ends - [len(w) for w in words], ends, table, weights)
    assert np.allclose(got, want)


def test_posterior_of_texts(spark):
    """Prediction and score of whole texts against sums over enumerated segmentations."""
    mark = language.MARK
    pieces = sorted({bytes([b]) for b in range(256)} | {mark, mark + b"ab", b"ba", b"abab"})
    rng = np.random.default_rng(2)
    table = rng.random((len(pieces), 2)) + 0.01
    model = language.Model(pieces, ["x", "y"], table / table.sum(axis=0), np.array([0.7, 0.3]))
    texts = ["abab ba", "BA ab", "ab " * 30, "b", "ababab  ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.predict(docs, model).collect():
        scores = np.log(model.prior)
        for word in texts[r.doc_id].lower().split():
            ways = segmentations(mark + word.encode(), set(pieces))
            scores = scores + np.log(sum(np.prod([model.table[pieces.index(p)] for p in w], axis=0) for w in ways))
        chance = np.exp(scores - scores.max())
        assert r.lang_pred == model.languages[int(scores.argmax())]
        assert r.score == pytest.approx(chance.max() / chance.sum())


def test_least_hashes_take_what_a_plain_sort_takes(spark):
    from quillspark.llm.tables import least_hashes
    rows = spark.range(30_000).selectExpr("cast(id as string) as id", "if(id % 10 < 8, 'big', if(id < 60, 'tiny', 'mid')) "
                                          "as lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    got = least_hashes(rows, sizes, "lang", "id", 50).collect()
    plain = collections.defaultdict(list)
    for r in rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 33)).collect():
        plain[r.lang].append((r.h, r.id))
    want = {(i, lang) for lang, own in plain.items() for _, i in sorted(own)[:50]}
    assert {(r.id, r.lang) for r in got} == want and len(plain["tiny"]) < 50


def test_language_accuracy_and_cases(spark, data_dir, documents, plain):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    model = language.fit(docs, PIECES)
    right = (language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
             .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0])
    assert right > 0.95
    got = language.predict(documents, model).collect()
    assert len(got) == len(plain)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101, 102, 107))
    assert all(0 <= r.score <= 1 for r in got)
    assert language.predict(documents, language.fit(documents.limit(0), PIECES)).where("lang_pred != 'und'").count() == 0
    assert language.predict(documents.limit(0), model).count() == 0


def test_quality(spark, data_dir, documents, plain):
    docs = spark.read.parquet(f"{data_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/../sf0.01/labels.parquet")
    model = quality.fit(docs, quality.grades(labels))
    assert (np.diff(model.thresholds) > 0).all()
    rated = quality.score(docs, model).join(quality.grades(labels), "doc_id", "left").withColumnRenamed("grade", "g")
    scored = quality.score(docs, model).join(quality.grades(labels).withColumnRenamed("grade", "given"), "doc_id")
    kept = {r["given"]: r["k"] for r in scored.groupBy("given").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[2] > 0.97 and kept[1] < 0.1 and kept[0] < 0.1
    assert rated.where("expected_grade < 0 or expected_grade > 2").count() == 0
    assert quality.score(documents, model).count() == len(plain)
    out = quality.keep(documents, model)
    assert out.columns == documents.columns and out.count() == quality.score(documents, model).where("kept").count()
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 0, 1)],
                                "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.grades(odd).collect()] == [(2, 0)]
    assert quality.fit(documents, quality.grades(odd)) is None
    assert quality.score(documents.limit(0), model).count() == 0 == quality.keep(documents.limit(0), model).count()


def test_quality_of_documents_left_out(spark, data_dir):
    """Each quarter of the labels at sf0.01 is judged by a model of the other three."""
    docs = spark.read.parquet(f"{data_dir}/../sf0.01/documents.parquet")
    graded = quality.grades(spark.read.parquet(f"{data_dir}/../sf0.01/labels.parquet"))
    kept, every = np.zeros(3), np.zeros(3)
    for quarter in range(4):
        own = F.pmod(F.xxhash64(F.lit("quarter"), "doc_id"), F.lit(4)) == quarter
        model = quality.fit(docs, graded.where(~own))
        left_out = graded.where(own).withColumnRenamed("grade", "given")
        for r in quality.score(docs, model).join(left_out, "doc_id").select("given", "kept").collect():
            kept[r["given"]] += r["kept"]
            every[r["given"]] += 1
    assert every.sum() == graded.join(docs, "doc_id").count()
    shares = kept / every
    assert shares[0] < 0.45 and shares[1] < 0.1 and shares[2] > 0.97, shares


def fill(budget, nodes):
    """nodes: name -> (weight, capacity). The level is raised step by step."""
    given, left = {}, dict(nodes)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = {n for n, (w, c) in left.items() if c <= w * level}
        if not full:
            given |= {n: w * level for n, (w, _) in left.items()}
            break
        for n in full:
            given[n] = left.pop(n)[1]
            budget -= given[n]
    return given


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (1.3, 2), (5.0, 2), (0.0, 2)])
def test_mixture_equals_brute_force(documents, plain, share, epochs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 3.0, ("en", "src1"): 2.0}
    got = collections.Counter(tuple(map(str, r)) for r in mixing.select(
        documents, levels, weights, share, epochs, 9).select("doc.doc_id", "leaf.*", "epoch", "budget").collect())
    count = {i: len(tokens(t)) - 1 for i, (_, t, *_) in enumerate(plain)}
    leaf = [(lang or "unknown", source or "unknown") for _, _, lang, source in plain]
    cap = collections.Counter()
    for i, key in enumerate(leaf):
        cap[key] += count[i]
    top = fill(math.floor(sum(cap.values()) * share), {
        lang: (weights.get((lang,), 1.0), epochs * sum(c for k, c in cap.items() if k[0] == lang))
        for lang in {k[0] for k in cap}})
    spark, want = documents.sparkSession, collections.Counter()
    for lang, budget in top.items():
        for key, b in fill(budget, {k: (weights.get(k, 1.0), epochs * c) for k, c in cap.items()
                                    if k[0] == lang}).items():
            b = math.floor(b + 1e-9)
            whole = b // cap[key] if cap[key] else 1
            own = [i for i in range(len(plain)) if leaf[i] == key]
            hashed = spark.createDataFrame([(i, plain[i][0]) for i in own], "i int, doc_id long").select(
                "i", mixing._order(9, F.lit(whole)).alias("h")).collect()
            units = collections.defaultdict(list)
            for r in hashed:
                units[r["h"]].append(r["i"])
            taken, room, is_open = set(), b - whole * cap[key], True
            for h in sorted(units):
                is_open = is_open and sum(count[i] for i in units[h]) <= room
                if is_open:
                    room -= sum(count[i] for i in units[h])
                    taken |= set(units[h])
            for i in own:
                for e in range(int(whole) + (i in taken)):
                    want[(str(plain[i][0]), *key, str(e), str(b))] += 1
    assert got == want


def test_mixture_of_nothing(documents):
    assert mixing.select(documents.limit(0), {"lang": F.col("lang")}, {}, 0.5, 1, 1).count() == 0


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["_lang", "_source", "_whole", "_cut", "_taken", "_epoch", "leaf", "doc", "budget", "whole"]
    docs = spark.range(40).selectExpr("id as doc_id", "'one two' as text", "'en' as lang",
                                      *[f"concat('{n}', id) as {n}" for n in names])
    got = mixing.select(docs, {"lang": F.col("lang")}, {}, 1.0, 1, 1).select("doc.*")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))

"""The pipeline's stages on a small data set, each against a plain version of its decision."""

import itertools
import re

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import quality, simhash
from quillspark.llm.tables import read
from quillspark.session import written


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages(spark, data_dir):
    docs = before = read(spark, data_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data_dir))
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    all_docs = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}

    model = quality.fit(before, quality.grades(read(spark, data_dir, "labels")))
    good = {r.doc_id for r in quality.score(before, model).where(F.col("tail_probability") >= quality.TAIL).collect()}
    assert set(kept["quality"]) == good and kept["quality"].items() <= all_docs.items()

    first = {}
    for doc_id in sorted(kept["quality"]):
        first.setdefault(spaced(all_docs[doc_id]), doc_id)
    assert set(kept["exact_dedup"]) == set(first.values())

    sets = {d: simhash.shingle_set(t or "") for d, t in kept["exact_dedup"].items()}
    group = {d: d for d in sets}
    changed = True
    alike = [p for p in itertools.combinations(sets, 2) if simhash.jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    while changed:  # the smallest doc_id spreads over links
        changed = False
        for a, b in alike:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    assert set(kept["simhash_near_dedup"]) == set(group.values())

    assert kept["mixture"].items() <= kept["simhash_near_dedup"].items() and kept["mixture"]
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(kept["mixture"])
    for _, own in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), lambda p: p.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= corpus_pipeline.SEQUENCE

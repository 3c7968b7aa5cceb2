import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import encoder, packing, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids(path, text, end):
    t = Tokenizer.from_file(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def files(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    token_files.write(documents, path, BYTE, 2)
    return path


def test_files_round_trip(spark, files, plain):
    got = token_files.checksums(token_files.read_tokens(spark, files)).orderBy("start").collect()
    assert [str(r.doc_id) for r in got] == [str(d) for d, *_ in sorted(
        plain, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert (sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
            == sorted((str(d), len(x), zlib.crc32(x)) for d, t, *_ in plain for x in [ids(BYTE, t, 2)]))


def test_selective_reads(spark, files):
    assert token_files.read_metadata(spark, files).columns == ["doc_id", "n_tokens", "start"]
    plan = token_files.read_tokens(spark, files, "doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert [r.doc_id for r in token_files.read_tokens(spark, files, "doc_id = 7").collect()] == [7]


def test_packing(documents, plain):
    size = 64
    got = packing.pack(documents, WORD, 1, size).collect()
    want = []
    for d, t, *_ in plain:
        x = ids(WORD, t, 1)
        want += [(str(d), i // size, i, len(x[i:i + size]), zlib.crc32(x[i:i + size])) for i in range(0, len(x), size)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    rooms = {}
    for r in got:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(rooms) <= -(-sum(w[3] for w in want) // size) + 1


def test_plan_beats_best_fit():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(5, 1, 20_000).astype(int) + 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.make_plan(counts)
    back = np.zeros_like(counts)
    for config, times in plan:
        assert times > 0 and sum(i * n for i, n in config.items()) <= 1024
        for i, n in config.items():
            back[i] += n * times
    assert (back == counts).all()
    bound = -(-int(lengths.sum()) // 1024)
    assert bound <= sum(t for _, t in plan) <= bound * 1.002 + 1


def test_empty_table(spark, documents, tmp_path):
    token_files.write(documents.limit(0), str(tmp_path / "e"), BYTE, 2)
    assert token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0
    assert packing.pack(documents.limit(0), WORD, 1, 64).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_unchanged_library(path):
    texts = ["one two <|endoftext|> three", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|startoftext|> x, y",
             "<|EndOfText|> no", "<|endoftext", "a|b <c>", "", "two\u3000 three <|endoftext|>", "plain text, twice  over"]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = []
    for _, all_ids, counts in encoder.PieceEncoder(path).documents(pa.array(texts)):
        got += [x.tolist() for x in np.split(all_ids, np.cumsum(counts)[:-1])]
    assert got == want
    assert len(want[0]) == (5 if path == BYTE else 4)

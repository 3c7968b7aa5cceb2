"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary, as bytes, and all single bytes. Each
language has a probability for every piece, estimated by expectation
maximisation: the expected number of uses of a piece over all segmentations of
the training words. A word's probability in a language is the sum over all its
segmentations, found by the forward algorithm; a text's is the product over its
words. The best posterior decides.

Words are runs without ASCII white space, lower-cased in A-Z, begun by the
vocabulary's word mark. Distinct words of a batch are scored once, for all
languages together, byte position by byte position.

Training takes at most ``PER_LANGUAGE`` documents of each language, those of the
least hash of doc_id: a bounded sample, collected as word counts. The prior is the share of
each language among all training documents.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows with a null doc_id are held out; without any training row everything is ``und``; ties go
to the language that sorts first; repeated rows are predicted alike, and a repeated training row counts
as often as it stands; a long text is scored whole, in sums of logarithms; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .tables import least_hashes, text_of

PER_LANGUAGE = 600
TURNS = 3
SMOOTH = 0.1
SLICE_BYTES = 1 << 21
MARK = "▁".encode()
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(path: str) -> list[bytes]:
    """All pieces of a sentencepiece file, and all single bytes, in sorted order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.add(model.id_to_piece(i).encode())
    return sorted(pieces)


class Lattice:
    """Finds the pieces of a vocabulary in words, by hash."""

    def __init__(self, pieces: list[bytes]):
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        keys = spans.hashes(data, ends - lengths, ends)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.lengths = np.unique(lengths).tolist()  # only these are looked up
        self.longest = self.lengths[-1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


class Hashes:
    """Hashes of any substrings of one byte array, from one pair of prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = spans._power_tables(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(spans._VALUES[data] * power[:len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return spans.mix((self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts]
                         + np.uint64(length))


def forward(lattice: Lattice, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray,
            keep: bool = False):
    """Log probability of every word in every language: (words, languages).

    ``table`` is (pieces, languages). Sums are kept in a ring of the last
    positions and rescaled at every position, so a word may be of any length.
    With ``keep`` all positions' sums, scales and edges are returned too.
    """
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    n, languages, window = len(starts), table.shape[1], lattice.longest + 1
    hashed = Hashes(data)
    ring = np.zeros((window, n, languages))
    ring[0] = 1.0
    log = np.zeros((n, languages))
    kept = []
    for end in range(1, int(size.max(initial=0)) + 1):
        m = int(np.searchsorted(-size, -end, side="right"))
        now = np.zeros((m, languages))
        found = []
        for length in lattice.lengths[:bisect.bisect_right(lattice.lengths, end)]:
            piece = lattice.find(hashed.of(begin[:m] + (end - length), length))
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                now[hit] += ring[(end - length) % window, hit] * table[piece[hit]]
                if keep:
                    found.append((length, hit, piece[hit]))
        scale = now
        log[:m] += np.log(scale)
        on = int(np.searchsorted(-size, -(end + 1), side="right"))  # words that go on after this position
        ring[end % window, :on] = 1.0
        for back in range(1, min(lattice.longest, end + 1)):
            ring[(end - back) % window, :on] /= scale[:on]
        if keep:
            kept.append((m, found, scale))
    out = np.empty_like(log)
    out[order] = log
    return (out, order, kept) if keep else out


def expected_counts(lattice: Lattice, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray,
                    weights: np.ndarray) -> np.ndarray:
    """Expected uses of every piece by every language: (pieces, languages). ``weights`` is (words, languages)."""
    _, order, kept = forward(lattice, data, starts, ends, table, keep=True)
    n, languages = weights.shape
    counts = np.zeros(table.shape)
    positions = len(kept)
    # alpha is 1 at every position after scaling; products of scales carry it from one position to another
    logs = np.zeros((positions + 1, n, languages))
    for end, (m, _, scale) in enumerate(kept, 1):
        logs[end] = logs[end - 1]
        logs[end, :m] += np.log(scale)
    size = (ends - starts)[order]
    beta = np.zeros((positions + 1, n, languages))
    beta[size, np.arange(n)] = 1.0  # relative to alpha: the share of the word's probability through a position
    for end in range(positions, 0, -1):
        m, found, _ = kept[end - 1]
        for length, hit, piece in found:
            share = (np.exp(logs[end - length, hit] - logs[end, hit]) * table[piece]) * beta[end, hit]
            beta[end - length, hit] += share
            weighted = share * weights[order[hit]]
            for j in range(languages):
                counts[:, j] += np.bincount(piece, weighted[:, j], len(counts))
    return counts


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], table: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.table, self.prior = pieces, languages, table, prior


def train(pieces: list[bytes], words: list[bytes], weights: np.ndarray, languages: list[str], prior: np.ndarray,
          turns: int = TURNS) -> Model:
    """Piece probabilities from words and their counts (words, languages)."""
    lattice = Lattice(pieces)
    lengths = np.array([len(p) for p in pieces], float)
    table = np.repeat((1.0 / 16 ** lengths)[:, None], len(languages), axis=1)
    table /= table.sum(axis=0)
    for _ in range(turns):
        total = np.zeros_like(table)
        for a in range(0, len(words), 20_000):
            part = words[a:a + 20_000]
            ends = np.cumsum([len(w) for w in part])
            data = np.frombuffer(b"".join(part), np.uint8)
            total += expected_counts(lattice, data, ends - [len(w) for w in part], ends, table,
                                     weights[a:a + 20_000])
        table = (total + SMOOTH) / (total + SMOOTH).sum(axis=0)
    return Model(pieces, languages, table, prior)


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, each begun by the mark."""
    lengths = ends - starts
    mark = np.frombuffer(MARK, np.uint8)
    total = lengths + len(mark)
    after = np.cumsum(total)
    out = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    for i, b in enumerate(mark):
        out[after - total + i] = b
    out[spans.ragged(after - lengths, lengths)] = data[spans.ragged(starts, lengths)]
    return out, after - total, after


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased distinct words (bytes, starts, ends), which one each word is, and words per document."""
    data = spans.LOWER[data]
    starts, ends, first = spans.words(data, offsets)
    _, one, which = np.unique(spans.hashes(data, starts, ends), return_index=True, return_inverse=True)
    return (*_marked(data, starts[one], ends[one]), which, np.diff(first))


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch of (lang, text)."""
    for batch in batches:
        data, offsets = spans.texts(batch.column(1))
        names = batch.column(0).to_pylist()
        for a, b in spans.slices(offsets, SLICE_BYTES):
            raw, starts, ends, which, counts = _distinct_words(data[offsets[a]:offsets[b]],
                                                               offsets[a:b + 1] - offsets[a])
            langs, code = np.unique(names[a:b], return_inverse=True)
            of_word = np.repeat(code, counts)
            pairs, times = np.unique(of_word * len(starts) + which, return_counts=True)
            text = raw.tobytes()
            words = [text[starts[i]:ends[i]] for i in (pairs % max(1, len(starts))).tolist()]
            yield pa.record_batch([pa.array([str(langs[i]) for i in pairs // max(1, len(starts))], pa.string()),
                                   pa.array(words, pa.binary()), pa.array(times)], names=["lang", "word", "n"])


def fit(docs: DataFrame, vocabulary_path: str, folds: int = 5, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most ``per_language`` training documents of each language; None if there are none."""
    rows = (docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"),
                        text_of(docs).alias("text"))
            .where((F.crc32(F.encode("id", "utf-8")) % folds != 0) & F.col("lang").isNotNull()))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    chosen = least_hashes(rows.select("id", "lang"), sizes, "lang", "id", per_language)
    sample = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # per_language rows of each language
    counted = (sample.select("lang", "text").mapInArrow(_count_rows, "lang string, word binary, n long")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow())
    if counted.num_rows == 0:
        return None
    langs, code = np.unique(counted.column("lang").to_pylist(), return_inverse=True)
    words, which = np.unique(np.array(counted.column("word").to_pylist(), object), return_inverse=True)
    weights = np.zeros((len(words), len(langs)))
    weights[which, code] = counted.column("n").to_numpy()
    by_lang = {r["lang"]: r["rows"] for r in sizes.collect()}  # of all training documents, not of the sample
    prior = np.array([by_lang[x] for x in langs], float)
    return train(vocabulary(vocabulary_path), words.tolist(), weights, [str(x) for x in langs], prior / prior.sum())


def _predict_rows(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, log_prior = Lattice(model.pieces), np.log(model.prior)
        for batch in batches:
            column = batch.column(2)
            data, offsets = spans.texts(column)
            for a, b in spans.slices(offsets, SLICE_BYTES):
                raw, starts, ends, which, counts = _distinct_words(data[offsets[a]:offsets[b]],
                                                                   offsets[a:b + 1] - offsets[a])
                scores = np.tile(log_prior, (b - a, 1))
                if len(starts):
                    of_word = forward(lattice, raw, starts, ends, model.table)
                    owner = np.repeat(np.arange(b - a), counts)
                    for j in range(len(model.languages)):
                        scores[:, j] += np.bincount(owner, of_word[which, j], b - a)
                best = scores.argmax(axis=1)
                posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                some = [t is not None and _LETTER.search(t) is not None for t in column.slice(a, b - a).to_pylist()]
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array([model.languages[i] if s else UNKNOWN for i, s in zip(best, some)], pa.string()),
                    pa.array(np.where(some, posterior, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds == 0,
                                  F.lit(True)).alias("held_out"),
                       docs["text"].cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict_rows(model), "doc_id long, held_out boolean, lang_pred string, score double")

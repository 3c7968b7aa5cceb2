"""Token ids of whole texts by a public tokenizer, encoding every distinct piece of text once.

A text is cut before each run of white space, and between an ASCII letter or
digit and an ASCII punctuation mark other than an apostrophe. No pre-token of the
tokenizers in use crosses such a place. The pieces are hashed, each distinct one
is encoded by the library, and the ids are put together again. Texts with white
space outside ASCII, or with the string of one of the tokenizer's added tokens
(such as <|endoftext|>), are encoded whole. Results are those of encoding whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import spans

SLICE_BYTES = 1 << 21
# pieces that a worker process keeps; beyond that it starts anew
KEEP_PIECES = 1_000_000
# a piece longer than this is encoded, but not kept
LONG_PIECE = 256
# white space to Unicode that is not among the ASCII ones cut at
_ODD_SPACE = re.compile(
    "[\x1c-\x1f\x85\xa0 ᠎ -     　﻿]")
_ODD_LEADS = np.zeros(256, bool)
_ODD_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[_ALNUM] = False
_MARK[39] = False

_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The encoder of this worker process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the library finds the strings of these tokens in a text before anything else; case only widens what is found
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))), re.IGNORECASE) if added else None
        self.added_leads = np.zeros(256, bool)
        self.added_leads[[b for t in added for x in (t.lower(), t.upper()) for b in x.encode()[:1]]] = True
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum())), counts

    def documents(self, column: pa.Array):
        """(first document, ids of all, ids per document) for slices of a string column."""
        data, offsets = spans.texts(column)
        for a, b in spans.slices(offsets, SLICE_BYTES):
            ids, counts = self._slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield a, ids, counts

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(offsets) - 1
        odd = self._odd(data, offsets)
        space = spans.SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _ALNUM[data[:-1]])
        cut[offsets] = True  # also ends; a position past the data is never a start
        starts = np.flatnonzero(cut[:-1])
        owner = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.append(starts[1:], len(data))
        whole = odd[owner]
        keep = ~whole
        piece_docs = owner[keep]
        at, lengths, pool = self._pieces(data, starts[keep], ends[keep])
        counts = np.bincount(piece_docs, lengths, docs).astype(np.int64)
        ids = pool[spans.ragged(at, lengths)]
        if not odd.any():
            return ids, counts
        # put the texts that were encoded whole in their places
        parts, place = [], np.concatenate([[0], np.cumsum(counts)])
        odd_all, odd_counts = self.whole([data[offsets[i]:offsets[i + 1]].tobytes().decode()
                                          for i in np.flatnonzero(odd)])
        odd_ids = iter(np.split(odd_all, np.cumsum(odd_counts)[:-1]))
        for i in range(docs):
            parts.append(next(odd_ids) if odd[i] else ids[place[i]:place[i + 1]])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents with white space outside ASCII or an added token. The byte test only skips documents that cannot have any."""
        odd = np.zeros(len(offsets) - 1, bool)
        suspect = np.unique(np.searchsorted(offsets, np.flatnonzero((_ODD_LEADS | self.added_leads)[data]), side="right") - 1)
        for i in suspect:
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
            odd[i] = (_ODD_SPACE.search(text) is not None
                      or self.added is not None and self.added.search(text) is not None)
        return odd

    def _pieces(self, data, starts, ends):
        """For each piece, where its ids are in a pool, how many there are, and the pool."""
        hashed = spans.hashes(data, starts, ends)
        distinct, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        new_ids, new_lengths = self.whole(pieces)
        new_starts = len(self.ids) + np.cumsum(new_lengths) - new_lengths
        pool = np.concatenate([self.ids, new_ids])
        where, lengths = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        where[known], lengths[known] = self.starts[at[known]], self.lengths[at[known]]
        where[fresh], lengths[fresh] = new_starts, new_lengths
        if len(self.keys) + len(fresh) <= KEEP_PIECES:
            short = new_lengths <= LONG_PIECE
            spot = at[fresh][short]
            self.keys, self.ids = np.insert(self.keys, spot, distinct[fresh][short]), pool
            self.starts = np.insert(self.starts, spot, new_starts[short])
            self.lengths = np.insert(self.lengths, spot, new_lengths[short])
        else:
            self.keys, self.ids = self.keys[:0], self.ids[:0]
            self.starts, self.lengths = self.starts[:0], self.lengths[:0]
        return where[which], lengths[which], pool

"""Whole-corpus encoding with a public byte-level BPE vocabulary, by speculation and verification.

Greedy longest match (an Aho-Corasick automaton over the vocabulary) proposes the tokens of each word;
a proposal is the BPE encoding exactly if every adjacent pair of its tokens is one BPE itself would leave
standing, so all pairs of a batch are tested at once against a table of pairs judged so far; only words
with a failing pair go through exact merging. Words recur, and so do the chunks between spaces: each
distinct one of a batch is encoded once and kept in a bounded cache; a document's ids are its chunks'
ids, joined.

Scale: documents are encoded where they lie (no shuffle), in Arrow batches bounded in rows; automaton,
pair table and cache belong to the worker process and are bounded by parameters.

Defined results: null and empty texts give an empty list (n_tokens 0); blank texts are encoded as any
other; strings that look like special tokens are ordinary text; repeated rows are each encoded; an empty
table gives no rows; other columns pass through if asked for.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept by a worker, and pairs of tokens judged.
CACHE_WORDS = 300_000
CACHE_PAIRS = 2_000_000
#: Longer words are encoded anew in each batch.
CACHE_CHARS = 48


def _ranges(major: str) -> str:
    """A regular-expression class body of all code points whose category begins with ``major``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """The vocabulary's word pattern: contractions, letters, numbers, other signs, white space.

    Unicode's White_Space is not Python's: U+001C to U+001F count as other signs.
    """
    letter, number = _ranges("L"), _ranges("N")
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Encoder:
    """Byte-level BPE over ranks, tokens numbered as in the vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.size = max(self.pieces) + 1
        self.auto = ahocorasick.Automaton()
        for piece, rank in self.ranks.items():
            self.auto.add_word(piece.decode("latin-1"), rank)
        self.auto.make_automaton()
        self.words: dict[str, bytes] = {}
        self.keys, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.chunks: dict[str, bytes] = {}
        self.find = word_pattern().findall
        self.cut = re.compile(r"(?<=\S) | (?=\S)").split
        self.doubtful = re.compile(r" \s").search

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: merge the lowest-ranked adjacent pair until none is left (a heap over a linked list)."""
        from heapq import heapify, heappop, heappush

        n, rank = len(word), self.ranks.get
        ends, prev, nxt, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or ends[j] != end:
                continue
            ends[i], alive[j], nxt[i] = end, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := rank(word[i:ends[nxt[j]]])) is not None:
                    heappush(heap, (r, i, ends[nxt[j]]))
            if (h := prev[i]) >= 0 and (r := rank(word[h:end])) is not None:
                heappush(heap, (r, h, end))
        return [self.ranks[word[i:ends[i]]] for i in range(n) if alive[i]]

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) stays as it is under BPE."""
        wanted, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        known = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        new = wanted[~known]
        if len(new):
            verdict = [self.merge(self.pieces[a] + self.pieces[b]) == [a, b] for a, b in zip((new // self.size).tolist(), (new % self.size).tolist())]
            if len(self.keys) + len(new) > CACHE_PAIRS:
                self.keys, self.good = wanted[known], self.good[at[known]]
            keys_, good = np.concatenate([self.keys, new]), np.concatenate([self.good, np.array(verdict)])
            order = np.argsort(keys_)
            self.keys, self.good = keys_[order], good[order]
        return self.good[np.searchsorted(self.keys, wanted)][back]

    def encode_words(self, words: Sequence[str]) -> Iterator[bytes]:
        """The ids of each word, as little-endian int32."""
        raw = [w.encode("utf-8", "replace") for w in words]
        propose = self.auto.iter_long
        ids, lengths = [], []
        for w in raw:
            got = [t for _, t in propose(w.decode("latin-1"))]
            ids += got
            lengths.append(len(got))
        flat, ends = np.array(ids, dtype=np.int64), np.cumsum(lengths)
        owner = np.repeat(np.arange(len(raw)), lengths)
        inner = owner[1:] == owner[:-1]
        bad = np.zeros(len(raw), bool)
        if inner.any():
            bad[owner[1:][inner][~self._judge(flat[:-1][inner] * self.size + flat[1:][inner])]] = True
        out, start = flat.astype("<i4").tobytes(), 0
        for w, end, failed in zip(raw, ends.tolist(), bad.tolist()):
            yield np.array(self.merge(w), dtype="<i4").tobytes() if failed else out[4 * start:4 * end]
            start = end

    def _chunks(self, text: str) -> list[str]:
        """The text cut before spaces; every chunk but the first has lost its leading space.

        A cut before a space changes no word if the character on either side of the space is no white space.
        """
        if text[-1] != " " and self.doubtful(text) is None:
            return text.split(" ")
        return self.cut(text)

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids in them."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        split = [self._chunks(t) if t else None for t in texts]
        heads = {c[0] for c in split if c}
        new = {c: self.find(" " + c) for c in set().union(*(c[1:] for c in split if c)).difference(self.chunks)}
        begun = {c: self.find(c) for c in heads}
        words, chunks = self.words, self.chunks
        unseen = [*set().union(*new.values(), *begun.values()).difference(words)]
        words.update(zip(unseen, self.encode_words(unseen) if unseen else ()))
        chunks.update((c, b"".join(map(words.__getitem__, found))) for c, found in new.items())
        first = {c: b"".join(map(words.__getitem__, found)) for c, found in begun.items()}
        parts = [first[c[0]] + b"".join(map(chunks.__getitem__, c[1:])) if c else b"" for c in split]
        for c in new:
            if len(c) > CACHE_CHARS:
                del chunks[c]
        for w in unseen:
            if len(w) > CACHE_CHARS:
                del words[w]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), "<i4"), offsets


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def encode_corpus(df: DataFrame, text: str, keep: Sequence[str], path: str | None = None, ids: bool = True, rows: int = 256) -> DataFrame:
    """``keep`` columns plus ``ids`` (array<int>), or only their number ``n_tokens`` if ``ids`` is off."""
    path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    slim = df.select(*keep, F.col(text).cast("string").alias("_text"))
    out = T.StructField("ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("n_tokens", T.IntegerType())
    schema = T.StructType([*(slim.schema[c] for c in keep), out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                flat, offsets = enc.encode_batch(b.column("_text").to_pylist())
                got = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)) if ids else pa.array(np.diff(offsets))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), got], names=[*keep, out.name])

    return slim.mapInArrow(run, schema)


def id_bytes(df: DataFrame, ids: str, keep: Sequence[str], path: str | None = None) -> DataFrame:
    """``keep`` columns plus ``n_bytes``, the length of the text that a row's ids spell."""
    path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    slim = df.select(*keep, ids)
    schema = T.StructType([*(slim.schema[c] for c in keep), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size = np.zeros(enc.size, np.int64)
        size[[*enc.pieces]] = [*map(len, enc.pieces.values())]
        for b in batches:
            a = b.column(ids)
            sums = np.concatenate([[0], np.cumsum(size[a.flatten().to_numpy(zero_copy_only=False)])])
            ends = np.cumsum(np.nan_to_num(pc.list_value_length(a).to_numpy(zero_copy_only=False)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(sums[np.concatenate([[0], ends])]))], names=[*keep, "n_bytes"])

    return slim.mapInArrow(run, schema)

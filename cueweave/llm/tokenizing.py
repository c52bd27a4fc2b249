"""Encoding with a public byte-level BPE (problem 6).

A task keeps the words it has met with their ids. The new words of a batch are encoded together: their bytes lie in one
array of linked symbols; an occurrence index maps each pair that some merge knows to all its positions; ranks are
applied in ascending order, each to all positions of its pair at once (numpy), and only the lists of the pairs beside a
merge are updated. A merge can only create pairs of higher rank, so no rank is visited twice.

Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary text;
whole texts are encoded; lone surrogates can't occur in columns; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import spread

#: Words kept per task; beyond it the table starts anew.
MEMO_WORDS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PairMerger:
    """Byte-level BPE of many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = int(max(ranks.values())) + 1
        # every split of a token into two tokens is a pair that makes it
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that a pair makes, -1 if none. Ids are ranks."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        length = np.array([len(w) for w in words], np.int64)
        # a wall (-1) behind each word, and one in front of all
        n = int(length.sum()) + len(words) + 1
        symbol = np.full(n, -1, np.int64)
        wall = np.zeros(n, bool)
        wall[0] = True
        wall[np.cumsum(length + 1)] = True
        symbol[~wall] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            if len(at) < 8:
                for p, r in zip(at.tolist(), rank.tolist()):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(np.array([p]))
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:])):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        first = np.arange(n - 1)
        add(first, self._rank(symbol[:-1], symbol[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            nxt = after[at]
            # positions that an earlier merge has changed are stale
            fresh = self._rank(symbol[at], symbol[np.minimum(nxt, n - 1)]) == rank
            at, nxt = at[fresh], nxt[fresh]
            if not len(at):
                continue
            if len(at) > 1 and (nxt[:-1] == at[1:]).any():  # a run of equal symbols pairs up from its left
                at = np.sort(at)
                taken, keep = -1, []
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep)
                nxt = after[at]
            symbol[at] = rank
            symbol[nxt] = -2
            beyond = after[nxt]
            after[at] = beyond
            before[beyond] = at
            back = before[at]
            add(back, self._rank(symbol[back], symbol[at]))
            add(at, self._rank(symbol[at], symbol[beyond]))
        alive = symbol >= 0
        word = np.cumsum(wall) - 1
        count = np.bincount(word[alive], minlength=len(words) + 1)[: len(words)]
        flat = symbol[alive].tolist()
        out, i = [], 0
        for c in count.tolist():
            out.append(flat[i : i + c])
            i += c
        return out


@lru_cache(maxsize=2)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Ids of texts, with the words met so far."""

    def __init__(self, path: str):
        self.merger, self.words, self.known = _merger(path), _pattern().findall, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MEMO_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.merger.encode([w.encode() for w in new])))

    def batch(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """The words of texts, learnt, in steps of bounded size."""
        step: list[list[str]] = []
        fresh: set[str] = set()
        size = 0
        for t in texts:
            words = self.words(t) if t else []
            step.append(words)
            fresh.update(words)
            size += len(words)
            if size > 2_000_000:
                self.learn(fresh)
                yield step
                step, fresh, size = [], set(), 0
        self.learn(fresh)
        yield step

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        return [[i for w in words for i in known[w]] for step in self.batch(texts) for words in step]

    def sizes(self, texts: list[str | None]) -> list[int]:
        known, out = self.known, []
        for step in self.batch(texts):
            size = {w: len(known[w]) for words in step for w in words}
            out += [sum(map(size.__getitem__, words)) for words in step]
        return out


def _bounded(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some bytes of text each; a longer text is a slice of its own."""
    lengths = [len(t) if t else 0 for t in batch.column(column).to_pylist()]
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every document. The vocabulary file is looked up where the task runs. No shuffle but that of `spread` on inputs with fewer splits than cores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or vocabulary_path())
        for batch in batches:
            for part in _bounded(batch, "text"):
                ids = encoder.ids(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or vocabulary_path())
        for batch in batches:
            for part in _bounded(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(encoder.sizes(part.column("text").to_pylist()), pa.int64())], names=["doc_id", "source", "tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, source string, tokens bigint")

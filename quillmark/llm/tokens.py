"""Problem 8: encoding of the corpus with a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece's bytes form a doubly linked list of symbols, and a
priority queue of merge ranks says which pair to join next.  Entries of pairs that have changed since are
stale and skipped, so a piece of n bytes costs O(n log n) however long it is.  Pieces repeat, so each
worker keeps the ids of the short ones (a bounded cache; it changes no result).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillmark.sources.tables import table

#: Where the vocabulary lies on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES, CACHED_BYTES = 200_000, 64


class ByteBPE:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.cut = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # symbol i is piece[i:end[i]]; its neighbours begin at end[i] and before[i]; end 0: joined away
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # stale: a part of this pair has been joined with another
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                right = end[stop]
                r = ranks.get(piece[i:right])
                if r is not None:
                    heapq.heappush(queue, (r, i, right))
            left = before[i]
            if left >= 0:
                r = ranks.get(piece[left:stop])
                if r is not None:
                    heapq.heappush(queue, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, special strings being ordinary text; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.cut.findall(text):
            ids = known.get(piece)
            if ids is None:
                # a lone surrogate cannot be in a Parquet string; replaced as the public libraries do
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their vocabulary strings joined; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str = VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """doc_id, ids (or n_tokens) of rows of doc_id, text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        for part in parts:
            texts, names = part.column("text"), part.column("doc_id")
            for at in range(0, part.num_rows, 1000):  # ids of long texts leave in small batches
                ids = [bpe.encode(t) for t in texts.slice(at, 1000).to_pylist()]
                lens = np.fromiter(map(len, ids), np.int32, len(ids))
                if lengths_only:
                    column = pa.array(lens)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([names.slice(at, 1000), column], names=["doc_id", "n_tokens" if lengths_only else "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ("n_tokens int" if lengths_only else "ids array<int>"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document; null, empty: the empty list."""
    return encoded(table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document."""
    return encoded(table(spark, sf_dir, "documents"), lengths_only=True)


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}

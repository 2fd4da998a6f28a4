"""Packing token sequences into fixed windows by best fit, longest first.

Documents are encoded where they lie; only pieces (a few integers each) are shuffled. Pieces
are dealt to bins of about ``docs_per_group`` documents by a hash of doc_id, start and checksum, so
neither a very long document nor many rows of one id fill a bin (rows equal in all do), and each bin
is packed on its own, so a task's memory and time don't grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Words kept with their ids by each Python worker; beyond that the memory is started anew.
CACHE = 700_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Word between blanks -> its ids as little-endian bytes.

    The tokenizer splits at white space before it merges, so a text's ids are those of its
    blank-separated words in a row; tests hold this against whole-text encoding.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for w, e in zip(new, encode(new, add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        get = self.__getitem__
        return [b"".join(map(get, words)) for words in split]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def cut(tokens: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Full windows first, then what is left: (start, length)."""
    return [(at, min(window, tokens - at)) for at in range(0, tokens, window)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Each document's pieces with checksums of their ids. Null text counts as empty: only ``end_id``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(ids), 256):
                part = [t or "" for t in texts.slice(first, 256).to_pylist()]
                out = []
                for doc, data in zip(ids[first : first + 256], words.encode(part), strict=True):
                    data += tail
                    n = len(data) // 4
                    out += [(doc, at, size, zlib.crc32(data[4 * at : 4 * (at + size)]), n) for at, size in cut(n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


class Room:
    """Segment tree over remaining capacity: how many open windows have it, and which."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, left: int, which: int) -> None:
        self.open[left].append(which)
        at = left + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least ``need`` that some window has; -1 if none."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, left: int) -> int:
        at = left + self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[left].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset for pieces that come longest first."""
    room, filled, where, offset = Room(window), [], [], []
    for n in lengths:
        left = room.tightest(n) if n < window else -1
        if left < 0:
            at = len(filled)
            filled.append(0)
            left = window
        else:
            at = room.take(left)
        where.append(at)
        offset.append(filled[at])
        filled[at] += n
        if left > n:
            room.add(left - n, at)
    return where, offset


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, docs_per_group: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Empty or null texts give one piece of the end id; an empty table gives no rows; repeated rows
    are packed as often as they occur; ties in length go by doc_id and start. Columns other than
    doc_id and text are ignored. ``sequence_id`` is unique over all groups.
    """
    groups = docs.count() // docs_per_group + 1

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit(t["length"].to_pylist(), window)
        sequence = (t["bin"].to_numpy().astype(np.int64) << 32) + np.array(where, np.int64)
        return t.drop_columns("bin").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces(docs, tokenizer, end_id, window).withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("bin").applyInArrow(fill, PIECES + ", sequence_id long, offset long")

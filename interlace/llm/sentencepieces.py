"""SentencePiece encoding that keeps, for every piece, where it begins in the source bytes.

A text is normalised by the longest prefix found in the model's compiled character map, with a
record of the source byte of every normalised byte. Merges never cross from a letter into a
following blank, nor over a line break (no piece of the vocabulary holds either, which is
checked when the model is loaded), so runs of blanks plus the word after them are encoded once
and remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
CHUNK = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n[^{BLANK}\n]*|[^{BLANK}\n]+")
#: Chunks kept by each Python worker; beyond that the memory is started anew.
CACHE = 600_000


class CharacterMap:
    """The compiled map: a double-array trie of prefixes, then their replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:], and what replaces it."""
        if not self.units:
            return None
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = jump(self.units[0]), None
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and the source byte of each of its bytes (None: unchanged)."""
        if not self.units:
            return text, None
        data, out, source, at = text.encode(), bytearray(), [], 0
        while at < len(data):
            if hit := self.longest(data, at):
                size, new = hit
            else:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                new = data[at : at + size]
            out += new
            source += [at] * len(new) if hit else range(at, at + size)
            at += size
        return out.decode(), [*source, len(data)]


class Encoder:
    """Chunk -> (ids joined by commas, decoded bytes, bytes of each piece)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = form.ModelProto.FromString(open(path, "rb").read())
        self.map = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.pieces = [p.piece for p in proto.pieces]
        self.byte = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.blank = self.library.piece_to_id(BLANK)
        spec = proto.normalizer_spec
        alone = not any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.pieces)
        if not (alone and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and self.byte):
            raise ValueError("this encoder needs a model with byte fallback, a dummy prefix and kept blanks, whose pieces hold no inner blank")
        self.known: dict[str, tuple] = {}

    def chunk(self, chunk: str) -> tuple:
        # the library adds no dummy prefix to an empty text
        ids = [self.blank] if chunk == BLANK else self.library.encode(chunk[1:] if chunk[0] == BLANK else chunk, num_threads=1)
        if chunk[0] != BLANK:
            if ids[0] != self.blank:
                raise ValueError("a piece spans the dummy prefix and a line break")
            ids = ids[1:]
        decoded, sizes = [], []
        for i in ids:
            data = self.byte.get(i) or self.pieces[i].encode()
            sizes.append(len(data))
            decoded.append(data.replace(BLANK.encode(), b" ") if i not in self.byte else data)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[chunk] = found = (",".join(map(str, ids)), b"".join(decoded), bytes(sizes))
        return found

    def parts(self, text: str) -> tuple[list[tuple], list[int] | None, bytes]:
        plain, source = self.map.normalise(text)
        known, marked = self.known, BLANK + plain.replace(" ", BLANK)
        return [known.get(c) or self.chunk(c) for c in CHUNK.findall(marked)] if text else [], source, plain.encode()

    def begins(self, parts: list[tuple], source: list[int] | None, plain: bytes) -> np.ndarray:
        """Source byte at which each piece begins."""
        if not parts:
            return np.zeros(0, np.int64)
        sizes = np.frombuffer(b"".join([p[2] for p in parts]), np.uint8).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        # in the marked text a blank has three bytes and one stands before the text; literal marks keep their three
        mark = BLANK.encode()
        raw = np.frombuffer(mark + plain.replace(b" ", mark), np.uint8)
        width = np.ones(len(raw) + 1, np.int64)
        three = np.flatnonzero((raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2]))
        if mark in plain:
            three = three[[True, *(m == b" " for m in re.findall(mark + b"| ", plain))]]
        width[three + 1] = width[three + 2] = 0
        width[:3] = 0
        place = np.concatenate([[0], np.cumsum(width[:-1])])[at]
        return np.array(source)[place] if source is not None else place


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins (source byte of each piece). Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                found = [e.parts(t or "") for t in part.column(1).to_pylist()]
                ids = [[int(i) for p in x[0] for i in p[0].split(",")] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([e.begins(*x) for x in found], pa.list_(pa.int64()))], ["doc_id", "ids", "begins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<long>")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, begins_crc32 of each whole text.

    Null and empty texts have no ids and decode to the empty text. Every row gives one row,
    repeated ones too; columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            out = []
            for first in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(first, 256).to_pylist():
                    parts, source, plain = e.parts(text or "")
                    ids = ",".join([p[0] for p in parts])
                    decoded = e.library.decode([int(i) for i in ids.split(",")]).encode() if ids else b""
                    begins = e.begins(parts, source, plain)
                    out.append((len(begins), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), zlib.crc32(begins.astype("<i8").tobytes())))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "begins_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, begins_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids, as the library decodes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            texts = [e.library.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

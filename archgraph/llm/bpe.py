"""Byte-level BPE encoding and decoding by a rank file (operator 10).

Pre-tokens, the matches of any pattern, that are tokens of the rank file encode as such; the
others go to length-bucketed padded matrices, where every row merges its leftmost pair of least
rank each round.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import kept
from .matrix_bpe import BYTE_LEVEL, MatrixMerger, PairTable, Units, portions


class Codec:
    """Encoder and decoder of one rank file with one pattern for pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        # a pair merges whenever its bytes together are a token, whichever the two parts are
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r, r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        columns = [np.array(x, np.int32) for x in zip(*pairs, strict=True)] if pairs else [np.empty(0, np.int32)] * 4
        self.merger = MatrixMerger([self.ranks[bytes([b])] for b in range(256)], PairTable(*columns))
        find = regex.compile(pattern)
        # whole matches, whatever groups the pattern has
        self.units = Units(lambda s: [m.group() for m in find.finditer(s)] if find.groups else find.findall(s), self._ids, (), cuts=pattern == BYTE_LEVEL)

    def _ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        raw = [p.encode() for p in pieces]
        got = [self.ranks.get(r) for r in raw]
        rest = [i for i, g in enumerate(got) if g is None]
        out = [(g,) for g in got]
        for i, ids in zip(rest, self.merger.encode([raw[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(row)) for row in self.units.batch(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process."""
    return kept(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``docs``.

    ``ids`` is array<int>, the encoding; decoded_sha256 is of the bytes that decoding the ids
    gives. A null text encodes as empty: no ids, the digests of nothing. Null ids stay null,
    repeated rows are each encoded, an empty table gives no rows, other columns are not read. One
    narrow pass, no shuffle; a worker holds one batch and tables of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            texts = [s or "" for s in b.column(1).to_pylist()]
            for part in portions(texts):
                rows = c.encode(texts[part])
                out = [b.column(0)[part], pa.array(map(len, rows), pa.int64()), pa.array([sha(",".join(map(c.text_of.__getitem__, r)).encode()) for r in rows]), pa.array([sha(c.decode(r)) for r in rows])]
                names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array(rows, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [*names, *["ids"] * with_ids])

    src = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("k", id_col) if id_col != "k" else out


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of token ids; null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [None if r is None else c.decode(r).decode("utf-8", "replace") for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    src = encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("i"))
    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("k", id_col) if id_col != "k" else out

"""Token counts of whole texts by a whole-token shortcut (operator 1).

Most pre-tokens of a text are themselves strings of the vocabulary. Whether such a string,
encoded alone, ends as that one token is a property of the merge table and is proven offline, by
merging every vocabulary string. A pre-token of the proven set counts 1 without any merging;
only the rest is merged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import kept
from .matrix_bpe import MatrixMerger, PairTable, Units, portions


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file: token strings as bytes, and a merger by its merge table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, chars = j["model"], byte_of_char()
        self.to_bytes = lambda s: bytes(map(chars.__getitem__, s))
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(pairs)), strict=True)]
        self.merger = MatrixMerger([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], PairTable(*ids))
        special = {t["content"] for t in j["added_tokens"]}
        self.special = sorted(special)
        pre = j.get("pre_tokenizer") or {}
        # texts may be cut at spaces if pre-tokens are those of the byte-level pattern on the text as it is
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not j.get("normalizer")
        self.tokens = [self.to_bytes(s) for s in vocab if s not in special]


def whole_tokens(path: str) -> frozenset[bytes]:
    """The vocabulary strings that encode alone as one token, each proven by merging it."""
    v = Vocabulary(path)
    return frozenset(t for t, ids in zip(v.tokens, v.merger.encode(v.tokens), strict=True) if len(ids) == 1)


def counts(path: str, whole: frozenset[bytes], texts: list[str]) -> list[int]:
    """The number of tokens of each text, with the tables of this process."""

    def units() -> Units:
        from tokenizers import Tokenizer

        v, library = Vocabulary(path), Tokenizer.from_file(path)
        pre, normal = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str if library.normalizer else str
        cut = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None

        def split(s: str) -> list:
            parts = cut.split(s) if cut else [s]  # odd ones are special strings
            return [x for i, p in enumerate(parts) for x in ([p] if i % 2 else [v.to_bytes(t) for t, _ in pre(normal(p))])]

        def value(pieces: list) -> list[int]:
            raw = [p if isinstance(p, bytes) else p.encode() for p in pieces]
            rest = [i for i, (p, r) in enumerate(zip(pieces, raw, strict=True)) if r not in whole and p not in v.special]
            out = [1] * len(raw)
            for i, ids in zip(rest, v.merger.encode([raw[i] for i in rest]), strict=True):
                out[i] = len(ids)
            return out

        return Units(split, value, 0, v.cuts, v.special)

    return [sum(row) for row in kept(("tokens", path), units).batch(texts)]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs`` by the vocabulary file at ``path``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are each
    counted; an empty table gives no rows. Special strings inside texts count as the library's
    default has it: one token each. Nothing but the two columns is read, so other columns of any
    name do no harm. One narrow pass, no shuffle; a worker holds a batch and two bounded tables.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [s or "" for s in b.column(1).to_pylist()]
            n = [x for part in portions(texts) for x in counts(path, whole.value, texts[part])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["k", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

import base64
import hashlib
import json
import random

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from archgraph.llm import base, bpe, fingerprints, matrix_bpe, token_count
from archgraph.llm.matrix_bpe import portions

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    r = random.Random(1)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "'s", "'ll", "1", "²", "½", "Ⅳ", "!", "漢", "😀", "​", "the", "\x00", "ñ", "_", "ẞ", "<|endo", " hello", " world."]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    out += ["".join(r.choice("aábctheinong漢!") for _ in range(r.randint(150, 3000))) for _ in range(20)]
    return [*out, "", " ", "ab" * 30_000, "a" * 20_000]


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    t, whole, some = Tokenizer.from_file(JSON), token_count.whole_tokens(JSON), texts()
    got = [n for part in portions(some) for n in token_count.counts(JSON, whole, some[part])]
    assert got == [len(e.ids) for e in t.encode_batch(some, add_special_tokens=False)]


def test_whole_tokens_are_those_that_the_library_leaves_whole():
    model, v = Tokenizer.from_file(JSON).model, token_count.Vocabulary(JSON)
    char = {b: c for c, b in token_count.byte_of_char().items()}
    whole = token_count.whole_tokens(JSON)
    for t in random.Random(2).sample(v.tokens, 500):
        assert (t in whole) == (len(model.tokenize("".join(map(char.__getitem__, t)))) == 1)


def test_ids_equal_the_library_and_decode_to_the_text():
    enc, c, some = library(), bpe.codec(RANKS, P.PATTERN), texts()
    ids = c.encode(some)
    assert ids == [enc.encode_ordinary(s) for s in some]
    assert [c.decode(i) for i in ids] == [s.encode() for s in some]


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (None, None, 5), (2, "", 5), (3, "é" * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    enc, t = library(), Tokenizer.from_file(JSON)
    got = sorted(map(tuple, token_count.token_counts(docs, JSON).collect()), key=str)
    assert got == sorted([(i, len((s or "").encode()), n := len(t.encode(s or "").ids), n > 1024) for i, s, _ in rows], key=str)
    out = bpe.encode_documents(docs, RANKS, P.PATTERN)
    for r in out.collect():
        s = next(x[1] or "" for x in rows if x[0] == r["doc_id"])
        assert r["ids"] == enc.encode_ordinary(s)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(s.encode()).hexdigest())
    assert sorted(r["text"] for r in bpe.decode_ids(out, RANKS, P.PATTERN).collect()) == sorted(s or "" for _, s, _ in rows)
    assert token_count.token_counts(docs.limit(0), JSON).count() == bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_other_patterns_and_settings_give_the_library_s_ids(tmp_path, monkeypatch):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    some = [*texts()[:600], "a 2024 b", "x1y 22  z"]
    for pattern in (r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+", r"(a|b)c?|\s?\S|\s", r"\S+\s*|\s+"):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        c = bpe.Codec(RANKS, pattern)
        assert c.encode(some) == [enc.encode_ordinary(s) for s in some]
    with open(JSON, encoding="utf-8") as f:
        j = json.load(f)
    j["pre_tokenizer"] |= {"add_prefix_space": True}
    j["normalizer"] = {"type": "Lowercase"}
    j["added_tokens"].append({**j["added_tokens"][0], "id": 7, "content": "!hello"})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(j, f)
    v = token_count.Vocabulary(path)
    assert not v.cuts and token_count.Vocabulary(JSON).cuts


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(matrix_bpe, "ENTRIES", 50)
    enc, c, some = library(), bpe.Codec(RANKS, P.PATTERN), texts()[:900]
    assert [i for j in range(0, 900, 90) for i in c.encode(some[j : j + 90])] == [enc.encode_ordinary(s) for s in some]


def test_a_worker_holds_the_tables_of_one_operator_at_a_time():
    voter = fingerprints._voter(0)
    assert fingerprints._voter(0) is voter
    made = bpe.codec(RANKS, P.PATTERN)
    assert list(base._KEPT.values()) == [made]
    assert fingerprints._voter(0) is not voter

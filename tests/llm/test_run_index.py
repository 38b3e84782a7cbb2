import hashlib
import random

import numpy as np
import pytest

from archgraph.llm import run_index


def brute(rows, length):
    """Of each row (id, text) its removed bytes as a mask, rows in the order of the corpus."""
    seen, out = set(), []
    for _, raw in rows:
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                mask[i : i + length] = True
            seen.add(w)
        out.append(mask)
    return out


def check(spark, rows, length, **k):
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc long")
    got = {r["doc_id"]: r for r in run_index.strip_repeats(docs, length, with_kept=True, **k).collect()}
    ordered = sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for (doc, raw), mask in zip(ordered, brute(ordered, length), strict=True):
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        r = got[doc]
        runs = int((np.diff(np.r_[0, mask]) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()), doc
        assert bytes(r["kept"]) == kept


@pytest.mark.parametrize("many", [6000, 3, 1])
def test_against_brute_force(spark, many):
    r = random.Random(3)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(50, 400))) for _ in range(12)]
    rows = [(None, base[0], 1), (5, None, 1), (6, "", 1), (7, "x" * 300, 1), (8, "xy" * 200, 1), (9, "x" * 150 + "y", 1)]
    for i in range(10, 70):
        text = "".join(r.choice(base)[r.randint(0, 40) : r.randint(60, 400)] + r.choice(["", "#", "漢"]) for _ in range(r.randint(1, 5)))
        rows.append((i, text, 1))
    check(spark, rows, 60, k=24, many=many)
    check(spark, rows, 100, many=many)


def test_index_samples_give_the_suffix_array_neighbours():
    texts = [b"abracadabra", b"cadabrac", b"", b"abra"]
    index = run_index.RunLengthIndex(texts)
    t = [*b"abracadabra", 256, *b"cadabrac", 257, 258, *b"abra", 259]
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    neighbour, match = index.matching_statistics()
    for a, b in zip(sa, sa[1:], strict=False):
        assert neighbour[b] == a
        assert match[b] == next(i for i in range(len(t)) if t[a + i] != t[b + i])
    assert index.run_length.sum() == len(t)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(100))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in run_index.strip_repeats(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert run_index.strip_repeats(docs.limit(0)).count() == 0


def test_passage_across_the_blocks_of_a_long_text(spark):
    r = random.Random(5)
    passage = "".join(r.choice("bcdfg") for _ in range(400))
    filler = lambda n: "".join(f"{r.getrandbits(64):016x}" for _ in range(n // 16))
    long = filler(run_index.BLOCK - 208) + passage + filler(300_000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in run_index.strip_repeats(spark.createDataFrame([(1, passage), (2, long), (3, long[-1000:])], "doc_id long, text string")).collect()}
    assert got == {1: (400, 0, 0), 2: (len(long), 400, 1), 3: (1000, 1000, 1)}


def test_equal_rows_settle_alike_however_they_come_in_batches():
    r = random.Random(8)
    rows = sorted((r.randint(0, 30), r.randint(0, 5), r.randint(0, 9), 0, r.randint(0, 2), 1) for _ in range(900))
    rows += [(7, 3, 2, 4, 60 + i, -1) for i in range(5)]

    def result(cuts, many):
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        out = run_index._settle_equal(10, many)(run_index._batch(run_index._ROW, *np.array(p).T) for p in parts if p)
        return sorted(tuple(x) for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True))

    whole = {}
    for a, x, doc, row, p, c in rows[:900]:
        whole.setdefault(a, {}).setdefault(x, []).append((doc, row, p, p + c + 9))
    for many in (2, 100):
        want = [(0, 0, 2, 4, 60 + i, 3) for i in range(5)]
        for a, by in whole.items():
            for nth, (_, occ) in enumerate(sorted(by.items())):
                want += [(1 if nth < many else 2, a, *occ[0])] * (len(by) > 1) + [(0, a, *o) for o in occ if o != occ[0]]
        for cuts in ([], [1], sorted(r.sample(range(900), 40)), range(1, 900)):
            assert result(cuts, many) == sorted(want)

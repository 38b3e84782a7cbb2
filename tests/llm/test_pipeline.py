"""The stages of the pipeline on the smallest tables, each against a plain version on its own input."""

import base64
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from archgraph.llm import simhash_dedup

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def least_of_groups(texts):
    """The least id of each group that links of similarity 0.8 connect, of {id: text}, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    order = sorted(texts)
    root = {i: i for i in order}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if similar(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in order}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, columns = rows(docs), docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "encode"]

    kept = by_name["quality"](spark, docs, SF).cache()
    good = rows(kept)
    assert kept.columns == columns and set(good) <= set(before)
    ids = {r[0] for r in good}
    assert np.mean([i in ids for i, q in labels.items() if q == 1]) >= 0.97  # clean documents stay
    assert np.mean([i in ids for i, q in labels.items() if q == 0]) <= 0.3

    lines = by_name["lines"](spark, kept, SF).cache()
    left = {r[0]: r[1] for r in rows(lines)}
    assert lines.columns == columns and set(left) == ids
    for r in good:
        own, new = r[1].split("\n"), left[r[0]].split("\n") if left[r[0]] else []
        it = iter(own)
        assert all(x in it for x in new)  # what is left stands in its order

    one = by_name["near_duplicates"](spark, lines, SF).cache()
    assert one.columns == columns
    assert sorted(r[0] for r in rows(one)) == sorted(least_of_groups(left))

    mixed = by_name["mixture"](spark, one, SF).cache()
    assert mixed.columns == columns
    there, copies = set(rows(one)), Counter(rows(mixed))
    assert set(copies) <= there and max(copies.values()) <= 2
    words = lambda c: sum(len(r[1].split()) * n for r, n in c.items())
    assert abs(words(copies) - 1.5 * words(Counter(there))) <= 0.1 * words(Counter(there))

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = by_name["encode"](spark, mixed, SF)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect())
    assert got == Counter((r[0], tuple(enc.encode_ordinary(r[1]))) for r in rows(mixed))


def odd(spark):
    """Documents with nulls in every column, empty and repeated rows, and further columns with names that operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    more = [tuple(r) for r in docs] + [tuple(docs[0])] * 3 + [(None, None, None, None, None), (None, docs[1]["text"], "en", None, 1), (9001, None, "en", "src1", None), (9002, "", None, "src0", 0), (9003, " \n ", "en", "src0", 3), (9002, "", None, "src0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, id long, k string, key int, n string, drop int, copies string"
    return spark.createDataFrame([(*r, "x", 1, "y", None, "z", 3, None) for r in more], schema)


def test_stages_take_odd_rows_and_clashing_columns(spark):
    docs = odd(spark)
    before, columns = Counter(map(repr, rows(docs))), docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_duplicates"):
        out = by_name[name](spark, docs, SF)
        got = Counter(map(repr, rows(out)))
        assert out.columns == columns and got and not got - before, name
    none = [r for r in rows(by_name["near_duplicates"](spark, docs, SF)) if not (r[1] or "").split()]
    assert [r[0] for r in none] == [9001]  # null, empty and blank texts are one group, a null id goes
    lines = rows(by_name["lines"](spark, docs, SF))
    assert Counter(repr((r[0], *r[2:])) for r in lines) == Counter(repr((r[0], *r[2:])) for r in rows(docs))
    assert [r[1] for r in lines if r[0] == 9001] == [None] and [r[1] for r in lines if r[0] == 9002] == ["", ""]
    mixed = rows(by_name["mixture"](spark, docs, SF))
    assert mixed and not {repr(r) for r in mixed} - set(before)
    assert max(Counter(map(repr, mixed)).values()) <= 2 * max(before.values())
    enc = rows(by_name["encode"](spark, docs, SF))
    assert len(enc) == docs.count() and {r[1] for r in enc if r[0] in (9001, 9002)} == {0}


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name


def test_two_runs_can_be_read_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    first = corpus_pipeline.run(spark, SF)
    n = first.count()
    second = corpus_pipeline.run(spark, SF)
    assert n == first.count() == second.count() > 0
    corpus_pipeline.close(second)
    assert sorted(r["ids_sha256"] for r in first.collect()) and first.count() == n
    paths = list(first._scratch_paths)
    assert paths
    corpus_pipeline.close(first)
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    assert not any(fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p)) for p in paths)


def test_near_duplicates_find_pairs_above_the_threshold(spark):
    """Of pairs of similarity 0.8 to 1, words of a text changed in one run or here and there, the share that is found."""
    r = np.random.default_rng(3)
    word = lambda k: [f"w{x}" for x in r.integers(0, 4000, k)]
    texts, pairs = {}, []
    for i in range(300):
        w = word(int(r.integers(60, 300)))
        v = list(w)
        if i % 2:
            at = int(r.integers(0, len(v)))
            v[at : at + max(1, len(v) // 12)] = word(max(1, len(v) // 12))
        else:
            for at in r.choice(len(v), max(1, len(v) // 60), replace=False):
                v[at] = word(1)[0]
        texts[2 * i], texts[2 * i + 1] = " ".join(w), " ".join(v)
        if similar(shingles(texts[2 * i]), shingles(texts[2 * i + 1])):
            pairs.append(i)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {x["doc_id"] for x in simhash_dedup.keep_similar(df, similarity=0.8, words=5).collect()}
    assert len(pairs) > 200
    assert np.mean([2 * i + 1 not in left for i in pairs]) >= 0.9
    assert all({2 * i, 2 * i + 1} <= left for i in range(300) if i not in pairs)

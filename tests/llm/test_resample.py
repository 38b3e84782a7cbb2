"""Importance resampling against plain counters."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from archgraph.llm.resample import feature_counts, resample

DOCS = "doc_id long, text string, lang string, weight string, rank int, t string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, buckets, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[bucket(a)] for a in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = fit[: percent * len(fit) // 100]
    rows = [(*r[:4], n) for n, r in enumerate(drawn, 1)]
    left = Counter(r[:4] for r in out) - Counter(r[:4] for r in drawn)
    return sorted(rows + [(*r, None) for r in left.elements()], key=repr)


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(i, x, "en", "w", 1, "t") for i, x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in resample(d, b, **options).collect()), key=repr)


def some(n, seed):
    r = random.Random(seed)
    pool = ["Ab", "ä1", "É", "x_y", "don't", "9", "the", "THE", "中文", "a\x00b", " ", "tail"]
    return [(i, r.choice([" ", "\n", "--", ", "]).join(r.choices(pool, k=r.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(n)]


def test_weights_scores_and_ranks(spark):
    docs = some(120, 1) + [(500, None), (501, ""), (502, "... --")]
    target = ["the tail of it", None, "", "the the the 9 don't"]
    for buckets in (10_000, 3):
        assert run(spark, docs, target, buckets=buckets) == brute(docs, target, buckets)


def test_repeated_rows_null_ids_and_ties(spark):
    docs = some(40, 2)
    docs = docs + docs[:10] + [(None, "the tail " * 12), (None, "the tail " * 12), (7, "the tail " * 12)]
    assert run(spark, docs, ["tail the tail"], percent=60) == brute(docs, ["tail the tail"], 10_000, percent=60)


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == []
    docs = some(30, 3)
    assert run(spark, docs, []) == brute(docs, [], 10_000)


def test_long_text_and_all_features_counted(spark):
    docs = [(1, "word other " * 200_000), (2, "word " * 30)]
    assert run(spark, docs, ["word"]) == brute(docs, ["word"], 10_000)
    got = {bytes(r["feature"]).decode(): r["n"] for r in feature_counts(spark.createDataFrame(docs, "i long, text string")).collect()}
    assert got == dict(Counter(f for _, x in docs for f in features(x)))

"""SimHash operators, line dedup, mixing and the quality classifier against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from archgraph.llm import base, fingerprints, line_dedup, mixing, quality, queries, simhash_dedup

SF = "/root/testdata/sf0.01"


def least_reachable(ids, near):
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 2**63 - 1).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def corpus():
    r = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = [(i, base[i % 60] if i < 90 else " ".join(base[i % 60].split()[:-1] + [r.choice(words)])) for i in range(150)]
    return [*rows, (200, None), (201, ""), (202, " \t"), (203, "A b\x0bC"), (204, "a B c d")]


def test_simhash_fingerprint_and_components(spark):
    rows = corpus()

    def brute(text):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))

    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_components(docs).collect()}
    ids, fp = [i for i, _ in rows], np.array([brute(t) for _, t in rows], np.uint64)
    assert [int(got[i]["fingerprint"], 16) for i in ids] == fp.tolist()
    assert [got[i]["component_id"] for i in ids] == least_reachable(ids, np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    kept = simhash_dedup.keep_one(docs, threshold=4, words=4)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g["component_id"] for g in got.values()})
    assert simhash_dedup.simhash_components(docs.limit(0)).count() == simhash_dedup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [1, 4, 7])
def test_anchors_find_every_link(spark, threshold):
    r = np.random.default_rng(0)
    fps = set()
    for b in r.integers(0, 2**63, 60).tolist():
        fps.add(b)
        for _ in range(5):
            fps.add(b ^ sum(1 << int(k) for k in r.choice(63, r.integers(1, threshold + 4), replace=False)))
    ids = sorted(fps)
    got = {r["node"]: r["component_id"] for r in simhash_dedup.fingerprint_components(spark.createDataFrame([(i,) for i in ids], "fp long"), threshold).collect()}
    a = np.array(ids).view(np.uint64)
    assert [got.get(i, i) for i in ids] == least_reachable(ids, np.bitwise_count(a[:, None] ^ a[None, :]) <= threshold)


def test_edited_fingerprints(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1.0) for x in [*rows, (None, "no id")]], "doc_id long, text string, near_next double")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = [*sorted(rows, reverse=True, key=lambda x: x[0]), (None, "no id")]
    fp = {i: int(got[i]["fingerprint"], 16) for i, _ in order}
    for (i, text), (j, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert int(r["edited_fingerprint"], 16) == int(fingerprints.Voter()([edited])[0])
        assert r["near_edited"] == 1 - (fp[i] ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
        assert r["near_next"] == 1 - (fp[i] ^ fp[j]).bit_count() / 64
        assert r["n_near"] == sum((fp[i] ^ x).bit_count() <= 3 for x in fp.values()) - 1
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_equal_votes_counted_one_by_one(spark):
    rows = [*corpus()[:40], (7001, "a a a b"), (7002, "b b b a"), (7003, " \n"), (7004, "é" * 90_000 + " x")]
    got = {r["doc_id"]: r["fp"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), seed=5).collect()}
    for i, text in rows:
        votes = [0] * 64
        for word in (text or "").split():
            h = xxhash.xxh64_intdigest(word.encode(), 5)
            votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
        assert got[i] % (1 << 64) == sum(1 << k for k, v in enumerate(votes) if v > 0)


def test_ids_and_rows_that_repeat_are_dealt_over_buckets(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(150, f"other {i}") for i in range(300)] + [(None, "")] * 200 + [(None, None)] * 100 + [(40, "same")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.with_next(docs, 16).withColumn("pid", F.spark_partition_id()).collect()
    own = [r for r in got if not r["look"]]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in own) == sorted((i is None, i or 0, t or "") for i, t in rows)
    sizes = Counter(r["pid"] for r in own)
    assert max(sizes.values()) <= 2.5 * len(rows) / 16 and {r["b"] for r in got if r["look"]} == {r["b"] for r in own}
    seen = [(r["doc_id"], r["text"]) for b in sorted(sizes) for r in got if r["pid"] == b and not r["look"]]
    place = [(i is None, -(i or 0)) for i, _ in seen]
    assert place == sorted(place)
    # after each bucket's last row stands the first one of the next bucket
    follow = {}
    for b in sorted(sizes):
        follow[b] = next((r["doc_id"], r["text"]) for r in got if r["pid"] == b and r["look"])
    firsts = {b: next((r["doc_id"], r["text"]) for r in got if r["pid"] == b and not r["look"]) for b in sorted(sizes)}
    order = sorted(sizes)
    assert [follow[b] for b in order] == [firsts[b] for b in [*order[1:], order[0]]]
    assert fingerprints.edited_fingerprints(docs).count() == len(rows)


def test_query_counts_lines_of_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "A line that is said twice over"), (4, "a line that is said twice over!"), (5, "a line that is said twice over\n"), (None, "\n\n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_left"], r["bytes_left"]) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (None, None, None), 2: (1, 1, 0), 3: (1, 1, 30), 4: (1, 0, 0), 5: (2, 1, 0), None: (3, 3, 2)}


def test_line_dedup(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600))
    near = long.replace("wordcb ", "")
    rows = [
        (1, "The first line of all lines here\nshort\nOnly in one document, this is it", "x"),
        (2, "the FIRST line, of all lines here!\nshort\nA line of its own that nobody repeats", "y"),
        (3, "The first line of all lines here", "y"),
        (4, None, None), (5, "", None), (6, long, None), (7, near + "\n\n", None), (8, "12 bottles of beer on a wall\n99 bottles of beer on a wall", None),
        (9, "repeats twice in itself, twice\nrepeats twice in itself, twice", None), (9, "repeats twice in itself, twice\nrepeats twice in itself, twice", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "A line of its own that nobody repeats"), (3, ""), (4, None), (5, ""), (6, long), (7, "\n"), (8, "12 bottles of beer on a wall"), (9, "repeats twice in itself, twice"), (9, "repeats twice in itself, twice")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_links_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randint(2, 10))) for _ in range(3000)]
    pairs = []
    for n in range(8, 41, 4):
        for share in (0.01, 0.05, 0.1, 0.2):
            for _ in range(12):
                a = [r.choice(vocab) for _ in range(n)]
                b = list(a)
                for j in r.sample(range(n), max(1, round(n * share))):
                    b[j] = r.choice(vocab)
                pairs.append((" ".join(a), " ".join(b)))
    some = ["Quarterly statement of earnings", "Quarterly statemment of earnings", "私たちは毎日新しい本を図書館で読みます", "私たちは毎日新しい本を図書室で読みます"]
    pairs += [tuple(some[:2]), tuple(some[2:])]
    docs = [(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    left = {g["doc_id"]: g["text"] for g in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = [distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    found = [left[2 * i + 1] == "" for i in range(len(pairs))]
    assert np.mean([f for f, n in zip(found, near, strict=True) if n]) >= 0.99
    assert not any(f for f, n in zip(found, near, strict=True) if not n)
    assert found[-2:] == [True, True]


def test_keys_of_lines_go_once_their_buckets_are_written(spark, monkeypatch):
    write, held = line_dedup.settle, {}

    def settle(df, name, **options):
        held.setdefault(name, [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in base.PATHS if p not in before])
        return write(df, name, **options)

    before = set(base.PATHS)
    monkeypatch.setattr(line_dedup, "settle", settle)
    docs = spark.createDataFrame([(1, "A line that is said twice over, or nearly so"), (2, "A line that is said twice over, or nearly, so\nand one more")], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == ["A line that is said twice over, or nearly so", "and one more"]
    assert "lines" not in held["buckets"]
    assert not {"lines", "distinct"} & set(held["stars"])


def _lines_of_own_words(rng, n, words, inside):
    """Lines of words that no other line has, around the words ``inside`` at the same place."""
    own = lambda k: ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(9)) for _ in range(k)]
    return [" ".join([*own(words // 2), *inside, *own(words // 2)]) for _ in range(n)]


def test_frequent_words_alone_make_no_candidates(spark, monkeypatch):
    rng, write, rows = random.Random(11), line_dedup.settle, {}

    def settle(df, name, **options):
        out = write(df, name, **options)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "settle", settle)
    lines = [x for some in ("of the the", "in of the", "the and a", "to the of", "and in the", "a of the") for x in _lines_of_own_words(rng, 5, 30, some.split())]
    _, _, links = line_dedup.line_links(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert links.count() == 0
    assert rows["stars"] == 0 and rows["rest"] == 0


def test_pairs_are_verified_in_slices_after_their_buckets_went(spark, monkeypatch):
    rng, write, held, calls = random.Random(12), line_dedup.settle, {}, Counter()

    def settle(df, name, **options):
        calls[name] += 1
        held.setdefault(name, {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in base.PATHS if p not in before})
        return write(df, name, **options)

    passage = "quarterly statement about earnings before interest payments".split()
    lines = _lines_of_own_words(rng, 5, 30, passage)
    lines += [x.replace(passage[0], "yearly") for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    whole = sorted(line_dedup.dropped_lines(docs).collect())
    assert [r["doc_id"] for r in whole] == [5, 6, 7, 8, 9]
    before = set(base.PATHS)
    monkeypatch.setattr(line_dedup, "settle", settle)
    monkeypatch.setattr(line_dedup, "SLICE", 2)
    assert sorted(line_dedup.dropped_lines(docs).collect()) == whole
    assert calls["edges"] > 1 and calls["extra"] > 1
    assert not {"buckets", "more", "split", "stars"} & held["extra"]


def test_grams_must_stand_where_the_edits_can_have_left_them(spark):
    """Shapes of 100 characters in 20 words: 20 edits move a gram by 20 characters before and behind it together."""
    shape = lambda size, words, place: (size << 36) | (words << 18) | place
    rows = [(shape(100, 20, 10), shape(100, 20, 20), True), (shape(100, 20, 10), shape(100, 20, 21), False), (shape(100, 20, 10), shape(80, 16, 10), True), (shape(100, 20, 10), shape(79, 16, 10), False), (shape(9 << 16, 20, 65535), shape(9 << 16, 20, 3), True)]
    got = spark.createDataFrame(rows, "a long, b long, close boolean").select("close", line_dedup._close("a", "b", 0.8).alias("got")).collect()
    assert [r["got"] for r in got] == [r["close"] for r in got]
    keys = spark.createDataFrame([("international statements of quarterly earnings",)], "n string").select(line_dedup._keys(F.col("n")).alias("k")).first()["k"]
    assert {k & 65535 for k in keys} == {0, 13, 23, 25, 34}


def test_pieces_prove_long_lines_and_only_such_as_link(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    rows = []
    for n in (96, 97, 300, 3000):
        a = text(n)
        cut, edits = rng.randrange(n), sorted(rng.sample(range(n), n // 50))
        some = "".join("" if i in edits[::2] else "xy" if i in edits else c for i, c in enumerate(a))
        rows += [(True, a, a), (True, a, some), (True, a, a[:cut] + text(n // 9) + a[cut:]), (True, a[: n // 3] + a[n // 3 + n // 9 :], a)]
        rows += [(False, a, text(n)), (False, a, a[: n // 2] + text(n // 2)), (False, a[::-1], a), (False, a, a[: n // 3])]
        rows += [(None, a, "".join(rng.choice("xyz") if rng.random() < 0.2 else c for c in a)), (None, a, "".join(c if rng.random() < 0.9 else c + text(2) for c in a))]
    t = spark.createDataFrame(rows, "near boolean, a string, b string").withColumn("most", F.floor(F.greatest(F.length("a"), F.length("b")) * 0.2).cast("int"))
    got = t.select("near", line_dedup._proven(F.col("a"), F.col("b"), F.col("most")).alias("proven"), F.expr("levenshtein(a, b) <= most").alias("links"), F.length("a").alias("n")).collect()
    assert not [r for r in got if r["proven"] and not r["links"]]
    assert not [r for r in got if r["near"] is False and r["links"]]
    long = [r for r in got if r["near"] and r["n"] > 200]
    assert len(long) == 8 and all(r["proven"] for r in long)


def test_the_driver_gives_back_what_the_fit_took(spark, monkeypatch):
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def fit(texts, labels, config):
        blocks = [bytes(3000) for _ in range(100_000)]
        pins.extend(blocks[::1000])  # what stays keeps the C library from giving back what is below it
        return len(texts)

    pins, calls, back = [], [], base.give_back
    monkeypatch.setattr(quality, "fit", fit)
    monkeypatch.setattr(quality, "give_back", lambda: (calls.append(held()), back(), calls.append(held())))
    docs = spark.createDataFrame([(i, "a text of words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.train(docs, labels) > 0
    assert len(calls) == 2 and calls[0] - calls[1] > 150


def test_lines_that_differ_in_digits_are_verified(spark):
    text = "Sum 1,203,441.50 of 88,127,405\nSum 7.25 of 3,960,118,226,914\nSum 1,203,441.50 of 88,127,406"
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == "\n".join(text.split("\n")[:2])


def test_lines_without_words_drop_as_exact_copies(spark):
    text = "+--------+--------+--------+\n| a |\n+--------+--------+--------+\n+------+----------+--------+\n| a |"
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == "+--------+--------+--------+\n| a |\n+------+----------+--------+"


def test_dropped_lines_of_the_corpus_equal_the_closure_of_candidates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, "All rights reserved\n\n \nPage one of it"), (-2, "all rights RESERVED.\n"), (None, "Page one of it")], docs.schema)).cache()
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}
    norm = lambda x: " ".join(regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", x.lower()).split()) or ("\n" + " ".join(x.split()) if x.strip() else "")
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    first, group = {}, {}
    for r in rows:
        for x in r["text"].split("\n"):
            first.setdefault(norm(x), len(first))
    some = [x for x in first if len(x) >= 20 and x[0] != "\n"]
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def within(a, b, most):
        if abs(len(a) - len(b)) > most:
            return False
        row = np.arange(len(b) + 1)
        y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
        for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
            new = np.r_[i, best]
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            if row.min() > most:
                return False
        return row[-1] <= most

    some.sort(key=len)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if len(a) < 0.8 * len(b) - 1e-9:
                break
            if set(a.split()) & set(b.split()) and within(a, b, int(0.2 * len(b) + 1e-9)):
                x, y = sorted((find(a), find(b)), key=first.get)
                root[y] = x
    seen, want = set(), set()
    for r in rows:
        kept = []
        for x in r["text"].split("\n"):
            if not norm(x) or find(norm(x)) not in seen:
                kept.append(x)
                if norm(x):
                    seen.add(find(norm(x)))
        want.add((r["doc_id"], "\n".join(kept)))
    assert len(got & want) >= 0.97 * len(want)


def expected_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", "B", "é", "z", None, "a"]), " ".join(["w"] * r.choice([0, 1, 5, 30, 31]))) for i in range(6000)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, s, t in rows] + [(None, None, "a", 1)], "doc_id long, text string, source string, copies int")
    got = mixing.mix(docs).collect()
    assert len(got) == 6001
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = expected_targets(sizes)
    for s, target in targets.items():
        mine = [g for g in got if g["source"] == s]
        assert {(g["source_size"], round(g["target"], 6)) for g in mine} == {(sizes[s], round(target, 6))}
        assert abs(sum(g["copies"] * g["size"] for g in mine) - target) <= 31
        assert all(0 <= g["copies"] <= 2 for g in mine)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(g["copies"] for g in got)
    assert mixing.mix(docs.limit(0)).count() == mixing.apply_mix(docs.limit(0)).count() == 0


def test_rows_that_repeat_are_mixed_as_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_STEP", 64)
    r = random.Random(8)
    rows = [(i, r.choice("ab"), " ".join(["w"] * r.randint(1, 9))) for i in range(400)] + [(None, "b", "x y z")] * 301 + [(5, "a", "")] * 70 + [(5, None, "one")] * 3
    docs = spark.createDataFrame([(i, t, s, n) for n, (i, s, t) in enumerate(rows)], "doc_id long, text string, source string, ones int")
    got = mixing.mix(docs).collect()
    assert Counter((g["doc_id"], g["source"], g["size"]) for g in got) == Counter((i, s, len(t.split())) for i, s, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    for s, target in expected_targets(sizes).items():
        mine = [g for g in got if g["source"] == s]
        assert abs(sum(g["copies"] * g["size"] for g in mine) - target) <= 9 and all(0 <= g["copies"] <= 2 for g in mine)
    same = Counter(g["copies"] for g in got if g["doc_id"] is None)
    due = expected_targets(sizes)["b"] / sizes["b"]
    assert abs(sum(c * n for c, n in same.items()) - 301 * due) <= 1 and max(same) - min(same) <= 1
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    out = mixing.apply_mix(docs).collect()
    assert Counter((x["doc_id"], x["source"], x["text"]) for x in out) == +_taken(rows, got)
    assert max(Counter(x["ones"] for x in out).values()) <= 2


def _taken(rows, got):
    """Copies of each (id, source, text), by the mix."""
    text = {(i, s, len(t.split())): t for i, s, t in rows}
    out = Counter()
    for g in got:
        out[g["doc_id"], g["source"], text[g["doc_id"], g["source"], g["size"]]] += g["copies"]
    return out


def test_pivot_keeps_chances():
    n = np.zeros(4)
    for k in range(3000):
        ones, held, _ = mixing.pivot([3, 10, 1, 7], [0.3, 0.3, 0.3, 0.3], True, mixing._draws(k))
        assert held is None
        n += ones
    assert np.abs(n / 3000 - 0.3).max() < 0.04


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    config = quality.Config(max_rows=300, bits=16)
    model = quality.train(docs, labels, config)
    rows = quality.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert right >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    odd = spark.createDataFrame([(None, None, 0.0), (1, "", 0.0), (2, "x " * 50_000, 0.0)], "doc_id long, text string, score double")
    assert [r["score"] for r in quality.quality_scores(odd, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()][:2] == [0.5, 0.5]
    assert quality.keep_quality(odd, model).columns == odd.columns
    assert quality.quality_scores(odd.limit(0), model).count() == 0
    assert (quality.train(docs, labels.limit(0), config).logits == 0).all()


def test_a_text_beyond_the_bound_does_not_end_the_sample(spark):
    docs, labels = [(i, f"good fine text {i}" if i % 2 else f"bad poor junk {i}") for i in range(60)], [(i, i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    first = labels.filter(~quality.held_out()).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    big = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 1000)).otherwise(F.col("text")))
    model = quality.train(big, labels, quality.Config(max_bytes=3000, bits=12, epochs=2, min_steps=80))
    assert (model.logits != 0).any()


def test_scores_equal_features_hashed_one_by_one():
    model = quality.Model(config := quality.Config(bits=10), np.random.default_rng(3).normal(size=1 << 10))
    mod, mix, base = 1 << 64, 0x9E3779B97F4A7C15, 0x100000001B3

    def bucket(h):
        h %= mod
        return ((h ^ (h >> 29)) * mix % mod) >> (64 - config.bits)

    def score(text):
        found, before = [], None
        for word in text.split():
            a = [c + 1 for c in b"<" + word.encode() + b">"]
            whole = sum(c * pow(base, k + 1, mod) for k, c in enumerate(a))
            found.append(bucket(whole))
            for n in config.grams:
                found += [bucket(sum(c * pow(base, n - 1 - k, mod) for k, c in enumerate(a[i : i + n])) + n) for i in range(len(a) - n + 1)]
            if before is not None:
                found.append(bucket((whole - before) * base + 3))
            before = whole
        return 1 / (1 + np.exp(-np.mean(model.logits[found]))) if found else 0.5

    texts = ["", "a", "one two one two two", "é 漢字 x-y " * 7, "  ", "long" * 500 + " tail"]
    assert quality.Scorer(model)(texts) == pytest.approx([score(t) for t in texts])


def test_folded_scores_equal_the_averages():
    model = quality.fit(["good fine text here", "bad bad bad"] * 20, [1, 0] * 20, quality.Config(bits=12, epochs=2, min_steps=80))
    words = "some fine bad text".split()
    buckets, offsets, hashes = quality.word_features(words, model.config)
    every = np.r_[buckets, quality.pair_buckets(hashes, 12)]
    assert quality.Scorer(model)(["", " ".join(words)])[1] == pytest.approx(1 / (1 + np.exp(-model.logits[every].mean())))

"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Every document of a source is due the same number of copies, target / size of the source. Its
fraction is rounded together with others: a pair of fractions transfers mass, in words, from one
to the other at random until one of them is integral, so that words taken stay on target and each
document keeps its chance. Groups of documents, dealt by a hash of the row, round independently
and each leaves one fraction at most; these residuals go up a reduction tree whose last group
rounds the last fraction of the source.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, forget, settle

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a group of the reduction tree, about.
FAN = 2048
_EPS = 1e-9
#: Rows that one list of repeated rows is at most expanded to.
_STEP = 1 << 16


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, target) of ``sizes(source, size)``: shares by weight, none above ``cap`` times its size.

    Sources stand in the order of their code points, a null source last. What a capped source
    can't take is shared again by weight. The levels are found by repeated sums over the table of
    sources, which stays distributed. Needs share <= cap. A source without words has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    part = settle(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    before, offset = 0, []  # a row for each partition of the sorted sources
    for r in sorted(part.groupBy(F.shiftright("at", 33).alias("p")).count().collect()):
        offset.append(F.when(F.shiftright("at", 33) == r["p"], F.lit(before)))
        before += r["count"]
    place = F.coalesce(*offset, F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    src = settle(part.select("source", "source_size", "n", weight.cast("double").alias("weight")), "weights")
    forget(part)
    everything = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, most = 0.0, F.col("source_size") * cap
    while True:  # each round caps one more source at least, mostly many
        full = F.col("weight") * F.lit(level) >= most
        r = src.agg(F.sum(F.when(full, most)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        new = (everything - (r["taken"] or 0)) / r["w"] if r["w"] else math.inf
        if not r["w"] or new <= level * (1 + 1e-12):
            break
        level = new
    fair = most if level == math.inf else F.least(most, F.col("weight") * F.lit(level))
    return src.select("source", "source_size", "n", fair.cast("double").alias("target"))


def _draws(*key) -> Iterator[float]:
    """Numbers of [0, 1) that depend on the key alone."""
    return iter(random.Random(repr(key)).random, None)


def pivot(size: list[int], share: list[float], last: bool, draws: Iterator[float]) -> tuple[list[int], int | None, float]:
    """Round ``share`` to 0 or 1 by pairs: (rounded, row left with a fraction or None, its fraction).

    Sums of size * share stay as they are, but for the last fraction of all, and so does the
    expectation of every share. Rows of size 0 carry no mass and are rounded down.
    """
    out, held, p = [0] * len(size), None, 0.0
    for i, (s, q) in enumerate(zip(size, share, strict=True)):
        if s == 0 or q <= _EPS:
            continue
        if q >= 1 - _EPS:
            out[i] = 1
            continue
        if held is None:
            held, p = i, q
            continue
        h = size[held]
        up, down = min(1 - p, q * s / h), min(p, (1 - q) * s / h)  # what the held row can gain or lose
        if next(draws) * (up + down) < down:
            p, q = p + up, q - up * h / s
        else:
            p, q = p - down, q + down * h / s
        ended = [(held, p), (i, q)]
        held, p = None, 0.0
        for k, x in ended:
            if x >= 1 - _EPS:
                out[k] = 1
            elif x > _EPS:
                held, p = k, x
    if held is not None and last:
        out[held], held = int(next(draws) < p), None
    return out, held, p


def _rounded(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, text_hash, times, whole, ones, copies): a row for each ``times`` rows that agree.

    Of these ``ones`` take whole + 1 copies, one takes ``copies`` and the others ``whole``. Equal rows
    are of equal size, so pairing them with each other leaves floor(times * share) ones and one
    fraction; that fraction alone is rounded with other rows, and no group holds the repeats.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash")).groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("times")), "sizes")
    targets = settle(source_targets(rows.select("source", (F.col("size") * F.col("times")).alias("size")), share, cap), "targets")  # joined by broadcast only if its files are small
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size")
    part = F.when(F.col("size") > 0, due - F.floor(due)).otherwise(0.0)
    ones = F.least(F.floor(F.col("times") * part), F.col("times") - 1)
    groups = F.greatest(F.ceil(F.col("n") / FAN), F.lit(1))
    level = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", rows["source"], "size", "text_hash", "source_size", "target", "n", key.alias("key"), "times", F.floor(due).cast("int").alias("whole"), ones.alias("ones"), (F.col("times") * part - ones).alias("share"), groups.alias("groups"), F.pmod("key", groups).alias("g"))
    most = targets.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 1
    names = level.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in level.schema) + ", copies int"

    def round_group(g: pa.Table) -> pa.Table:
        g = g.sort_by([("size", "descending"), ("key", "ascending"), ("text_hash", "ascending")])  # what is left is small
        first = {c: g.column(c)[0].as_py() for c in ("source", "groups", "g", "key")}
        draws = _draws(seed, *first.values(), len(g))
        ones, held, p = pivot(g.column("size").to_pylist(), share := g.column("share").to_pylist(), first["groups"] == 1, draws)
        copies = [w + x for w, x in zip(g.column("whole").to_pylist(), ones, strict=True)]
        if held is not None:
            share[held], copies[held] = p, None
        g = g.set_column(g.column_names.index("share"), "share", pa.array(share, pa.float64()))
        return g.append_column("copies", pa.array(copies, pa.int32()))

    done = []
    while True:
        out = settle(level.groupBy("source", "g", "groups").applyInArrow(round_group, schema), "rounded")
        done.append(out.filter("copies is not null"))
        if most <= 1:
            break
        most = -(-most // FAN)
        level = out.filter("copies is null").withColumn("g", F.floor(F.col("g") / FAN)).withColumn("groups", F.ceil(F.col("groups") / FAN)).select(*names)
    forget(rows)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("doc_id", "size", "source", "source_size", "target", "text_hash", "times", "whole", "ones", "copies")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, text_hash) of every row of ``docs``.

    ``size`` counts words, 0 for null or empty texts; such rows get the whole copies of their
    source, but none of the rounding. ``copies`` is at
    most ceil(cap). Null ids and null sources are values of their own. The draws depend on seed,
    source and the rows of a group, and groups on hashes of the rows, so that reruns agree
    whatever the partitioning; repeated rows are interchangeable, added up before they are
    shuffled and told apart at the end. An empty table gives no rows.
    """
    r = _rounded(docs, share, cap, seed, id_col, text_col, source_col)
    runs = F.array(F.struct((F.col("whole") + 1).alias("copies"), F.col("ones").alias("n")), F.struct("copies", F.lit(1).cast("long").alias("n")), F.struct(F.col("whole").alias("copies"), (F.col("times") - F.col("ones") - 1).alias("n")))
    out = r.withColumn("run", F.explode(F.filter(runs, lambda x: x["n"] > 0)))
    # in two steps, so that no list is long
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("run.n") - 1) / _STEP))))
    out = out.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("run.n") - F.col("i") * _STEP, F.lit(_STEP).cast("long")))))
    return out.select(F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", F.col("run.copies").alias("copies"), "text_hash")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, all columns as they are.

    Rows that agree in id, source and text share out their copies among them. Options as for
    :func:`mix`; the columns must be named doc_id, text and source.
    """
    key = ["_id", "_source", "_hash"]
    most = F.greatest(F.when(F.col("ones") > 0, F.col("whole") + 1).otherwise(F.col("whole")), "copies")
    taken = _rounded(docs, **options).filter(most > 0).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "ones", "whole", "copies")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)  # names that can't clash, whatever the columns of docs are called
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "text")}
    d = d.withColumns({"_id": at["doc_id"], "_source": at["source"], "_hash": F.xxhash64(F.coalesce(at["text"], F.lit("")))})
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    t = taken.toDF(*[f"{c}_t" for c in taken.columns])
    n = F.when(F.col("_k") <= F.col("ones_t"), F.col("whole_t") + 1).when(F.col("_k") == F.col("ones_t") + 1, F.col("copies_t")).otherwise(F.col("whole_t"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_t")) for c in key]
    out = d.join(t, on).withColumn("_n", n).filter("_n > 0")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), "_n"))).select(*names).toDF(*docs.columns)

"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.shared import settle

#: Bins of a round, parts of a hot group's rows, and rows up to which a group is left to Spark's own median.
BINS, SALT, SMALL = 1024, 16, 100_000


def exact_median(df: DataFrame, keys: list[str], value: str, small: int = SMALL) -> DataFrame:
    """(keys.., median, n): the median of the non-null numbers of each group, as a double, and its number of rows.

    Groups of up to ``small`` rows take Spark's median, which holds a group's values in one task.
    In a larger one the middle values are found by rounds of histograms: each counts the rows in
    ``BINS`` parts of the range that is left, map side first, and goes on in the one part that
    holds the rank, until its least and largest value agree. So no task holds a group, and the
    rounds grow with the logarithm of the range. Null keys are a group; one without numbers has
    a null median; NaN counts as larger than all numbers.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = settle(df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("_v")), "values")
    held = rows.groupBy(*names).agg(F.count("*").alias("n"), F.count("_v").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count_if(F.isnan("_v")).alias("_nan"))
    sizes = settle(held, "sizes")
    large = sizes.filter(F.col("_m") > small)
    few = sizes.filter(F.col("_m") <= small)
    f = few.toDF(*[f"_f{c}" for c in few.columns])
    plain = rows.join(f, [rows[n].eqNullSafe(f[f"_f{n}"]) for n in names], "left_semi").groupBy(*names).agg(F.median("_v").alias("median"), F.count("*").alias("n"))
    # of each large group the one or two ranks in its middle; NaNs are last and cut off where no rank meets them
    ranks = F.array_distinct(F.array(F.floor((F.col("_m") - 1) / 2), F.floor(F.col("_m") / 2)))
    numbers = rows.filter(~F.isnan("_v"))
    top = numbers.groupBy(*names).agg(F.max("_v").alias("_top"))
    t = top.toDF(*[f"_t{n}" for n in names], "_top")
    state = large.join(t, [large[n].eqNullSafe(t[f"_t{n}"]) for n in names], "left").select(*names, "n", F.explode(ranks).alias("_rank"), "_lo", F.col("_top").alias("_hi"), "_m", "_nan")
    state = settle(state.select(*names, "n", "_rank", F.when(F.col("_rank") >= F.col("_m") - F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_rank") >= F.col("_m") - F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_hi")).alias("_hi"), F.lit(0).cast("long").alias("_below")), "ranks")
    salted = numbers.withColumn("_s", F.pmod(F.xxhash64("_v", F.spark_partition_id()), F.lit(SALT)).cast("int"))
    while state.filter("_lo < _hi").limit(1).count():
        open_ = state.filter("_lo < _hi")
        o = open_.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).toDF(*[f"_o{n}" for n in names], "_on", "_rank", "_lo", "_hi", "_below", "_os")
        met = salted.join(o, [salted[n].eqNullSafe(o[f"_o{n}"]) for n in names] + [F.col("_s") == F.col("_os")]).filter("_v >= _lo and _v <= _hi")
        # halves first, as the width of a range may be no double
        place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = met.groupBy(*names, "_on", "_rank", "_below", F.least(F.floor(F.coalesce(place, F.lit(0.0)) * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = F.sum("_c").over(Window.partitionBy(*names, "_rank").orderBy("_bin"))  # BINS rows of a rank at most
        here = bins.withColumn("_upto", F.col("_below") + upto).withColumn("_before", F.col("_upto") - F.col("_c")).filter("_before <= _rank and _rank < _upto")
        moved = here.select(*names, F.col("_on").alias("n"), "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_before").alias("_below"))
        state = settle(moved.unionByName(state.filter("not (_lo < _hi)")), "ranks")
    middle = state.groupBy(*names).agg(F.avg("_lo").alias("median"), F.max("n").alias("n"))
    out = plain.unionByName(middle)
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "median", "n")

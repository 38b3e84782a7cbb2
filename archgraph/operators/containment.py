"""Which texts contain which names (D15, H6, D22, C9), by an inverted index of grams.

Each name is looked for by the one of its grams that fewest texts hold: texts give postings of the
grams in use, an equi-join brings names and texts together, and only these pairs are compared. So
neither side is broadcast and no name meets a text that lacks its rarest gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter names are their own gram.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters, 1 to ``GRAM``; one pass over the text, however long."""
    runs = F.array().cast("array<string>")
    for k in range(1, GRAM + 1):
        runs = F.when(size == k, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).otherwise(runs)
    return F.array_distinct(runs)


def contained_pairs(texts: DataFrame, names: DataFrame, text_id: str = "text_id", text: str = "text", name: str = "name") -> DataFrame:
    """(text_id, name): each of ``texts(text_id, text)`` with each distinct name that it contains; case counts.

    ``text_id`` must be unique. Null texts and names, and empty names, are in no pair; repeated
    names count once. A gram that a third of the texts hold is met only by names with no rarer one.
    """
    t = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    n = names.select(F.col(name).alias("_name")).filter("_name <> ''").distinct()
    own = n.withColumn("_size", F.least(F.length("_name"), F.lit(GRAM)))
    sizes = own.agg(F.collect_set("_size")).scalar()  # GRAM numbers at most
    of_name = own.select("_name", F.explode(_grams(F.col("_name"), F.col("_size"))).alias("_gram"))
    postings = t.select("_id", "_text", F.explode(sizes).alias("_size")).select("_id", F.explode(_grams(F.col("_text"), F.col("_size"))).alias("_gram"))
    in_use = postings.join(of_name.select("_gram").distinct(), "_gram", "left_semi")
    df = in_use.groupBy("_gram").agg(F.count("*").alias("_df"))
    # a gram that no text holds rules its name out
    rarest = of_name.join(df, "_gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_gram").alias("gram"))).alias("_r")).filter("_r.df > 0")
    candidates = in_use.join(rarest.select("_name", F.col("_r.gram").alias("_gram")), "_gram").select("_id", "_name")
    found = candidates.join(t, "_id").filter(F.contains("_text", "_name"))
    return found.select(F.col("_id").alias(text_id), F.col("_name").alias(name))


def containing_pairs(paths: DataFrame, names: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """(path, name): distinct paths and names of which one contains the other."""
    p, n = paths.select(path).distinct(), names.select(name).distinct()
    down = contained_pairs(p.withColumn("text_id", F.col(path)), n, text=path, name=name).select(F.col("text_id").alias(path), name)
    up = contained_pairs(n.withColumn("text_id", F.col(name)), p, text=name, name=path).select(path, F.col("text_id").alias(name))
    return down.unionByName(up).distinct()


def decisions_of_paths(paths: DataFrame, decisions: DataFrame) -> DataFrame:
    """(path, decision_id) of each distinct path with the decisions(decision_id, files) that have an affected file which contains it, ignoring case."""
    p = paths.select("path", F.lower("path").alias("low")).distinct()
    f = decisions.select("decision_id", F.explode("files").alias("file")).withColumn("text_id", F.lower("file"))
    texts = f.select("text_id").distinct().withColumn("text", F.col("text_id"))
    hit = contained_pairs(texts, p.select("low"), name="low")
    return hit.join(f.select("decision_id", "text_id").distinct(), "text_id").join(p, "low").select("path", "decision_id").distinct()


def relevant_decisions(files: DataFrame, decisions: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, decision_id) of each file of ``files(path)`` with the decisions(decision_id, prefix, block_id) whose file holds it or is held by it, or whose block it is in by ``owners(path, block_id)``."""
    near = containing_pairs(files, decisions, name="prefix")
    by_file = near.join(decisions.select("decision_id", "prefix"), "prefix").select("path", "decision_id")
    by_block = files.select("path").join(owners.select("path", "block_id"), "path").join(decisions.select("decision_id", "block_id"), "block_id").select("path", "decision_id")
    return by_file.unionByName(by_block).distinct()

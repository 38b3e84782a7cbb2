"""The queries opN_<name> over the whole test tables, thin over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of documents by byte_bpe_50k.json; a null text counts as empty."""
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document its numbers of lines before and after, and the digest of what is left.

    A null text has null counts and a null digest; an empty one is of one blank line, which stays. Of a
    text all of whose lines go no line is left, as none but a blank one could be.
    """
    from .line_dedup import dedup_lines

    blank = F.col("text").rlike(r"(?:^|\n)\s*(?:\n|$)")  # has a blank line: it stays
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"), blank.alias("has_blank"))
    out = dedup_lines(docs, similarity=0.8)
    left = F.when((F.col("text") == "") & ~F.col("has_blank"), 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", "n_lines", left.alias("n_left"), F.octet_length("text").alias("bytes_left"), F.sha2("text", 256).alias("text_sha256"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more among all embeddings, with the component of each; vectors without a direction link with nothing."""
    from .vector_dedup import Config, near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), Config(threshold=0.95))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text of documents over shingles of four words, with components of links within four bits."""
    from .simhash_dedup import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), threshold=4, words=4)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of documents and of its edited form, with their likeness; null texts count as empty."""
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"), radius=3)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of all words takes of each document, by the sources' weights."""
    from .mixing import mix

    m = mix(table(spark, sf_dir, "documents"), share=1.5, cap=2.0)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back, repeated payloads as revisits; a null html is empty."""
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), min_dedup=0).drop("intact")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text of documents by a classifier that has not seen the held-out labels."""
    from .quality import quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents in passages of 100 bytes that also start earlier; null texts count as empty."""
    from .run_index import strip_repeats

    return strip_repeats(table(spark, sf_dir, "documents"), length=100)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of documents by byte_bpe_multi_50k.tiktoken, decoded again; null texts count as empty."""
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    from .lm_score import score_texts

    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    out = score_texts(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's texts and the ranks of the drawn quarter."""
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, seed=7)


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten Lloyd rounds with eight centroids over all embeddings of 64 components."""
    from .lloyd import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_run_index": op9_run_index,
    "op10_bpe": op10_bpe,
    "op11_lm_score": op11_lm_score,
    "op12_resample": op12_resample,
    "op13_lloyd": op13_lloyd,
}


def _lloyd_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """Each round as a materialised query over the one before."""
    near = """SELECT i, x, unnest(list_transform(list_sort(list(struct_pack(d := list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)))[1:1], lambda b: b), recursive := true)
        FROM v, c{r} GROUP BY i, x"""
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda a: CAST(floor(CAST(a AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda a: a IS NOT NULL AND isfinite(CAST(a AS DOUBLE)))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS c, x AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT c, g, CAST(sum(x[g]) AS BIGINT) AS s, count(*) AS n FROM n{r}, range(1, {dims + 1}) AS t(g) GROUP BY c, g),
            f{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY g) AS m FROM s{r} GROUP BY c),
            c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN f{r} USING (c))""")
    return ",\n        ".join(parts) + f"""
        SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM n{rounds} JOIN v USING (i) JOIN c{rounds} USING (c)"""


_RESAMPLE_SQL = """
        WITH crc AS MATERIALIZED (SELECT list(e ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS e FROM range(256) AS r(b))),
        words AS MATERIALIZED (
            SELECT d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT true AS d, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark)),
        numbered AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM words),
        feats AS MATERIALIZED (SELECT d, i, unnest(w || list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS f FROM numbered),
        dict AS MATERIALIZED (SELECT f, count(*) FILTER (d) AS s, count(*) FILTER (NOT d) AS t FROM feats GROUP BY f),
        hashed AS MATERIALIZED (
            SELECT f, s, dict.t AS t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(f))), lambda j: CAST('0x' || substr(hex(encode(f)), 2 * j + 1, 2) AS BIGINT))),
                   lambda x, y: xor(x >> 8, crc.t[1 + CAST((xor(x, y)) & 255 AS BIGINT)])), 4294967295) % 10000 AS b
            FROM dict, crc),
        buckets AS MATERIALIZED (SELECT b, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM hashed GROUP BY b),
        gains AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM buckets) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM buckets) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM buckets),
        sums AS (SELECT i, CAST(sum(g) AS BIGINT) AS total FROM feats JOIN hashed USING (f) JOIN gains USING (b) WHERE d GROUP BY i),
        weighed AS (
            SELECT doc_id, len(w) AS n, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features,
                   CASE WHEN total IS NULL THEN 0 ELSE (total - ((total % (2 * len(w) - 1)) + 2 * len(w) - 1) % (2 * len(w) - 1)) // (2 * len(w) - 1) END AS weight,
                   CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM numbered LEFT JOIN sums USING (i) WHERE d),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
        placed AS (SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n >= 20) OVER () AS fit FROM scored)
        SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM placed
"""

#: DuckDB SQL where SQL can express the query; tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT *, sha1(h) AS s, count(*) OVER (PARTITION BY h) AS copies, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (SELECT *, list_aggregate(list_transform(string_split(s, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (strpos('0123456789abcdef', c) - 1), 4)), 'string_agg', '') AS bits FROM d)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b
    """,
    "op12_resample": _RESAMPLE_SQL,
    "op13_lloyd": _lloyd_sql(),
}

"""WARC writing and reading with boundary-chain verification (operator 7).

Writing: one record per row; records with equal payloads are deduplicated, the least id keeps the
payload as a response, the others become revisits that refer to it.

Reading: files are cut at the record magic by Spark's splittable text reader, so a task sees the
candidates of its split only. A candidate's headers tell where its successor starts. Whether a
candidate is a record or magic inside a payload is not visible from the bytes around it; only
the chain from the start of the file tells. Each task follows its candidates' chains to the end
of its split, and pointer jumping over these per-split links finds the candidates that the file's
start reaches. All others are bytes of a payload and are put back into their record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, scratch, settle

MAGIC = "WARC/1.1\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r$", re.I | re.M)
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r$", re.M)


def with_base32_sha1(df: DataFrame, data: str, name: str) -> DataFrame:
    """``df`` with a column: the bare upper-case base32 of the SHA-1 of column ``data``, by built-in functions."""
    bits = F.concat(*(F.lpad(F.conv(F.substring("_sha1", 10 * i + 1, 10), 16, 2), 40, "0") for i in range(4)))
    digits = (F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring("_bits", 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32))
    return df.withColumn("_sha1", F.sha1(data)).withColumn("_bits", bits).withColumn(name, F.concat(*digits)).drop("_sha1", "_bits")


def write_warc(pages: DataFrame, path: str, min_dedup: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files under ``path``, one for each task.

    Null html is an empty payload, a null url an empty target. Of rows with equal payloads of
    ``min_dedup`` bytes or more the least page_id (null first) is the response; rows repeated
    with that id too are responses. Payloads are compared by SHA-256 and length.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha2(html, 256).alias("key"))
    # payloads stay where they are: only ids and digests are shuffled, and of these only shared ones come back
    small = settle(rows.select("page_id", "key", "n"), "payloads")
    first = small.filter(F.col("n") >= min_dedup).groupBy("key", "n").agg(F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("first"), F.count("*").alias("copies"))
    shared = settle(first.filter("copies > 1").select("key", F.lit(True).alias("shared"), F.col("first.page_id").alias("first")), "shared")
    out = rows.join(shared, "key", "left")  # by broadcast only if the files of shared are small
    revisit = F.col("shared").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    with_base32_sha1(out, "html", "digest").select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    forget(small)
    forget(shared)


def _splits(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[str, int, list]]:
    """(file, block, chunks) of each split, its chunks as an iterator of rows in the order of the file."""
    held, rows = None, []
    for b in batches:
        for file, block, *row in zip(*(b.column(i).to_pylist() for i in range(2 + columns)), strict=True):
            if (file, block) != held:
                if held:
                    yield *held, rows
                held, rows = (file, block), []
            rows.append(row)
    if held:
        yield *held, rows


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split a row with its size, and of each candidate where its chain leaves the split.

    Places count from the split's first byte. The chain of a candidate goes over its successors;
    one that meets no candidate inside the split is broken and gets no row.
    """
    names = ["file", "block", "start", "out", "last"]
    for file, block, rows in _splits(batches, 2):
        places, at = [], 0
        for size, _ in rows:
            places.append(at)
            at += size + len(MAGIC)
        end, leave = at, {}
        for place, (_, need) in zip(reversed(places), reversed(rows), strict=True):
            if need is None:
                continue
            to = place + need
            if to >= end:
                leave[place] = (to, place)
            elif to in leave:
                leave[place] = leave[to]
        out = [(place, *leave[place]) for place in places if place in leave] + [(-1, end, -1)]
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array([block] * len(out), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], names)


def verify_chains(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, int | None, int | None]]:
    """(file, block) -> (base, entry, carry) of each split of the files under ``path``.

    ``base`` is the place of the split's first chunk, ``entry`` the first verified record that
    starts in it, ``carry`` the verified record that reaches into it. Places count chunks with
    their magic, so that a record's place is ten more than its byte offset. The result has one
    row for each input split, of which Spark's driver keeps a list anyway.
    """
    head = F.substring_index("value", "\r\n\r\n", 1)
    length = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    need = F.when(length != "", length.cast("long") + F.octet_length(head) + len(MAGIC) + 8)
    links = settle(_chunks(spark, path).select("file", "block", F.octet_length("value").cast("long").alias("size"), need.alias("need")).mapInArrow(_links, "file string, block long, start long, out long, last long"), "links")
    sizes = {(r["file"], r["block"]): r["out"] for r in links.filter("start = -1").collect()}
    base, at = {}, {}
    for file, block in sorted(sizes):
        base[file, block] = at.get(file, 0)
        at[file] = base[file, block] + sizes[file, block]
    if not base:
        return {}
    bases = F.broadcast(spark.createDataFrame([(*k, v) for k, v in base.items()], "file string, block long, base long"))  # a row for each split
    ends = F.broadcast(spark.createDataFrame(list(at.items()), "file string, total long"))
    jump = links.filter("start >= 0").join(bases, ["file", "block"]).select("file", *((F.col(c) + F.col("base")).alias(c) for c in ("start", "out", "last")))
    hops = jump.select("file", "start", "out", "last")
    jump = settle(jump.join(ends, "file").filter("out < total").select("file", "start", "out"), "jump")
    reach = settle(ends.select("file", F.lit(len(MAGIC)).cast("long").alias("start")), "reach")
    n = len(at)
    while True:  # in each round the verified set grows by as many hops as it has, and the hops double
        more = settle(reach.unionByName(reach.join(jump, ["file", "start"]).select("file", F.col("out").alias("start"))).distinct(), "reach")
        if (now := more.count()) == n:
            break
        n, reach = now, more
        via = jump.select("file", F.col("start").alias("out"), F.col("out").alias("to"))
        jump = settle(jump.join(via, ["file", "out"]).select("file", "start", F.col("to").alias("out")), "jump")
    # a split has at most one entry, and a file that does not start with a record none
    verified: dict[str, list] = {}
    for r in more.join(hops, ["file", "start"]).collect():
        verified.setdefault(r["file"], []).append((r["start"], r["out"], r["last"]))
    out: dict = {}
    for (file, block), b in base.items():
        of, end = verified.get(file, []), b + sizes[file, block]
        out[file, block] = (b, next((s for s, _, _ in of if b <= s < end), None), next((x for _, to, x in of if x < b < to), None))
    return out


def _parse(file: str, start: int, data: bytes, with_payload: bool) -> tuple:
    head, _, block = data[len(MAGIC) :].partition(b"\r\n\r\n")
    fields: dict = {k.lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head + b"\r\n")}
    block = block[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get(b"content-type", "").startswith("application/http") else (b"", b"", block)
    declared = _LENGTH.search(http + b"\r\n")
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get(b"warc-type", "")
    size = int(declared[1]) if declared else len(payload)
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    intact = None if kind == "revisit" else own == digest and size == len(payload)
    row = (file, start - len(MAGIC), kind, fields.get(b"warc-record-id", ""), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri", ""), digest if kind == "revisit" else own, size, intact)
    return (*row, None if kind == "revisit" else payload) if with_payload else row


_RECORD = "file string, offset long, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, intact boolean"


def _need(value: bytes) -> int:
    """Bytes of the record whose first chunk is ``value``, magic and closing line breaks included."""
    head, _, _ = value.partition(b"\r\n\r\n")
    return len(MAGIC) + len(head) + 8 + int(_LENGTH.search(head + b"\r\n")[1])


def _pieces(batches: Iterator[pa.RecordBatch], at: dict) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, record, place, bytes, whole) of verified records; a record that leaves its split comes in pieces."""
    magic = MAGIC.encode()
    split = file = record = need = None
    parts: list[bytes] = []
    place = first = 0

    def flush() -> Iterator[tuple[str, int, int, bytes, bool]]:
        if record is not None and parts:
            data = b"".join(parts)
            yield file, record, first, data, len(data) == need

    for b in batches:
        for f, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            value = value.as_py()
            if (f, block) != split:
                yield from flush()
                split, file = (f, block), f
                place, entry, record = at.get(split, (0, None, None))
                first, parts, need = place, [], None
            if place == entry:
                yield from flush()
                record = first = place
                parts, need = [], _need(value)
                entry = place + need
            if record is not None:
                parts.append(magic + value)
            place += len(value) + len(magic)
    yield from flush()


def _record_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += 200 + (len(r[9] or b"") if len(r) > 9 else 0)
        if n > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the uncompressed WARC files under ``path``.

    Columns: file, offset (bytes), warc_type, record_id, refers_to, target_uri, payload_digest
    (of a revisit as declared, else of the bytes read), payload_bytes (of the full payload),
    intact (whether length and digest are as declared; null for revisits), payload (null for
    revisits). Magic inside payloads starts no record. Files are split among tasks; only records
    that reach over the end of a split, because of magic in their payload, are put together by a
    shuffle. What follows a broken record in its file can't be reached and is not returned, nor
    is a record cut off by the end of its file. No files give no rows.
    """
    at = verify_chains(spark, path)
    shared = spark.sparkContext.broadcast(at)  # a row for each input split
    text = _RECORD + ", payload binary" * with_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in text.split(", "))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _record_batches((_parse(f, r, data, with_payload) for f, r, _, data, ok in _pieces(batches, shared.value) if ok), schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, r, place, data, ok in _pieces(batches, shared.value):
            if not ok:
                yield pa.RecordBatch.from_pydict({"file": [f], "record": [r], "place": [place], "data": [data]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, r, b"".join(x["data"] for x in parts)) for b in batches for f, r, parts in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _record_batches((_parse(f, r, data, with_payload) for f, r, data in rows if len(data) == _need(data[len(MAGIC) :])), schema)

    chunks = _chunks(spark, path).withColumn("value", F.col("value").cast("binary"))
    out = chunks.mapInArrow(whole, text)
    if any(carry is not None for _, _, carry in at.values()):
        # all files again, since Spark would split a part of them elsewhere
        parts = chunks.mapInArrow(cut, "file string, record long, place long, data binary")
        out = out.unionByName(parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("parts")).mapInArrow(joined, text))
    return out


def archive_pages(pages: DataFrame, path: str | None = None, min_dedup: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files (to the shared folder unless ``path`` is given) and read them back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to) of each row, in the
    type of page_id; a null page_id comes back as null.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, min_dedup)
    kind = pages.select("page_id").schema[0].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    return read_warc(spark, path, with_payload=False).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "intact")

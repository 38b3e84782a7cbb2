import base64
import hashlib

from archgraph.llm import warc


def _sha(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string")


def test_round_trip_with_magic_in_payloads_over_many_splits(spark, tmp_path):
    fake = "x" * 50 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nabcdefg\r\n\r\n"
    rows = [(i, f"http://h/{i}", ["plain é %d" % i, fake * (i % 5) + str(i), "WARC/1.1\r\n" * (i % 7) + str(i), "same"][i % 4], "f") for i in range(160)]
    rows += [(500, None, None, None), (501, "u\r\nX: y", "", "f"), (None, "u", "same", "f"), (502, "u", fake * 80, "f")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("3000", "1m"):
        path = f"file://{tmp_path}/{size}"
        warc.write_warc(_pages(spark, rows).repartition(3), path)
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = warc.read_warc(spark, path).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
            spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        assert len(got) == len(rows)
        html = {f"<urn:page:{'' if r[0] is None else r[0]}>": r[2] or "" for r in rows}
        first = {}
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            first.setdefault(r[2] or "", f"<urn:page:{'' if r[0] is None else r[0]}>")
        for g in got:
            h = html.pop(g["record_id"])
            assert (g["payload_bytes"], g["payload_digest"]) == (len(h.encode()), _sha(h))
            if first[h] == g["record_id"]:
                assert (g["warc_type"], g["refers_to"], g["intact"], bytes(g["payload"])) == ("response", None, True, h.encode())
            else:
                assert (g["warc_type"], g["refers_to"], g["payload"]) == ("revisit", first[h], None)
        assert not html


def test_small_payloads_are_not_deduplicated(spark):
    got = warc.archive_pages(_pages(spark, [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)]), min_dedup=3).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_empty_table_and_broken_file(spark, tmp_path):
    assert warc.archive_pages(_pages(spark, [])).count() == 0
    (tmp_path / "x.warc").write_bytes(b"no magic first WARC/1.1\r\nContent-Length: 1\r\n\r\na\r\n\r\n")
    (tmp_path / "y.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 1\r\n\r\na\r\n\r\nWARC/1.1\r\nContent-Length: 99\r\n\r\ncut off")
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r["warc_type"], bytes(r["payload"]), r["offset"]) for r in got] == [("resource", b"a", 0)]

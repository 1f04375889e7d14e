import gzip

import pytest
from pyspark.sql import functions as F

from spendtrace.llm import warc
from spendtrace.llm.staging import new_folder, stored

PAGES = "page_id long, url string, html string, file string, record_type string"
ROWS = [
    (5, "http://a/ b", "<p>same</p>", "x", "y"),
    (2, None, "<p>same</p>", None, None),
    (9, "http://a/2", "<p>same</p>", "x", "y"),
    (7, "http://a/3", None, "x", "y"),
    (3, "http://a/4", "", "x", "y"),
    (4, "http://a/5", "é\r\n\r\nWARC/1.1 \U0001f642", "x", "y"),
    (6, "http://a/6", "long " * 300_000, "x", "y"),
    (9, "http://a/2", "<p>same</p>", "x", "y"),
    (None, "http://a/7", "<p>same</p>", "x", "y"),
    (None, "http://a/8", "only", "x", "y"),
]


def expected(rows, min_bytes=0):
    groups = {}
    for page_id, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= min_bytes
            out.append((i, len(payload), warc.digest_of(payload), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def records(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 1, 100])
def test_roles_and_digests(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    assert records(warc.archive_pages(pages, min_bytes)) == expected(ROWS, min_bytes)


def test_no_pages(spark):
    assert records(warc.archive_pages(spark.createDataFrame([], PAGES))) == []


def test_archives_roll_and_keep_payloads(spark):
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    written = stored(warc.write_archives(pages, new_folder(spark, "w"), archive_bytes=20), "w")
    files = written.select("file").distinct()
    assert files.count() == len(ROWS)
    index = stored(warc.normalise_archives(files, warc.revisits(written), new_folder(spark, "n")), "i")
    got = {r.payload for r in warc.read_archives(index).where("record_type = 'response'").collect()}
    assert {bytes(p) for p in got} == {(html or "").encode() for _, _, html, *_ in ROWS}


def test_members_and_index_agree(folder):
    records = [(1, b"first"), (2, b"second" * 100_000), (3, b"")]
    body = b"".join(warc.record_head("response", i, "u", warc.digest_of(p), len(p), len(p)) + p + b"\r\n\r\n" for i, p in records)
    whole = gzip.compress(body)
    with open(f"{folder}/m.warc.gz", "wb") as f:
        f.write(whole)
    assert warc.normalise_file(f"{folder}/m.warc.gz", f"{folder}/n.warc.gz", {2: 1}) == 3
    data = open(f"{folder}/n.warc.gz", "rb").read()
    kinds = []
    for line in open(f"{folder}/n.warc.gz.idx"):
        offset, length, kind, _ = line.split("\t")
        kinds.append(kind)
        assert gzip.decompress(data[int(offset) : int(offset) + int(length)]).startswith(b"WARC/1.1")
    assert kinds == ["response", "response", "revisit"]
    for name, damaged in (("t", whole[: len(whole) // 2]), ("d", whole[:40] + b"\x00\xff" * 8 + whole[56:])):
        with open(f"{folder}/{name}.warc.gz", "wb") as f:
            f.write(damaged)
        with pytest.raises(ValueError):
            warc.normalise_file(f"{folder}/{name}.warc.gz", f"{folder}/{name}2.warc.gz", {})

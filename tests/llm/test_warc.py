"""Archives: round trips, ranges of any size, members that aren't, and the odd pages."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from lautwerk.llm import warc

PAGES = "page_id long, url string, html string, payload string, h1 string, least string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def expected(rows, least_bytes=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            b = (html or "").encode()
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= least_bytes and b in first and (i is None or first[b] < i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def returned(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a.example/x y\r\nInjected: 1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (0, "u", ""), (None, "u", "<p>one</p>"), (4, "u", "ä€😀" * 30_000),
    (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "z"), (6, "u", "z"), (7, "u", "z"), (None, None, None), (-3, "u", "negative"), (8, "u", "negative"),
]


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 25])
def test_round_trip_of_odd_pages(spark, range_bytes):
    assert returned(warc.round_trip(pages_of(spark, ROWS), range_bytes=range_bytes)) == expected(ROWS)


def test_small_payloads_may_all_be_responses(spark):
    assert returned(warc.round_trip(pages_of(spark, ROWS), least_bytes=9)) == expected(ROWS, 9)


def test_a_hot_payload(spark):
    rows = [(i, "u", "same" if i % 3 == 0 else f"own {i}" if i % 2 else f"pair {i // 4}") for i in range(3000)]
    assert returned(warc.round_trip(pages_of(spark, rows))) == expected(rows)


def test_no_pages(spark):
    assert warc.round_trip(pages_of(spark, [])).collect() == []


def reader(data):
    return lambda n, at: data[at : at + n]


def archive(n=60, level=None):
    """Records whose payloads are hard to press, some with the magic of gzip in them, and where each starts."""
    rng, parts, starts = random.Random(5), [], []
    for i in range(n):
        junk = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000])))
        payload = junk + (warc.MAGIC + junk[:7]) * (i % 3)
        whole = gzip.decompress(warc.record(i, "u", payload, None))
        parts.append(warc.record(i, "u", payload, None) if level is None else gzip.compress(whole, level))
        starts.append(sum(map(len, parts[:-1])))
    return b"".join(parts), starts


@pytest.mark.parametrize("level", [None, 0])
@pytest.mark.parametrize("step", [1, 37, 700, 5000, 10**9])
def test_each_record_belongs_to_one_range(step, level):
    data, starts = archive(level=level)
    got = []
    for a in range(0, len(data), step):
        got += [(at, n) for at, n, _, _ in warc.records(reader(data), len(data), a, a + step, chunk=977)]
    assert [at for at, _ in got] == starts
    assert [at + n for at, n in got] == [*starts[1:], len(data)]


def test_what_is_cut_off_or_damaged_is_left_out():
    data, starts = archive(20)
    bad = bytearray(data)
    bad[starts[4] + 30] ^= 255
    cut = bytes(bad[: starts[19] + 25])
    got = [at for at, *_ in warc.records(reader(cut), len(cut), 0, len(cut))]
    assert got == [s for k, s in enumerate(starts) if k not in (4, 19)]
    padded = data[: starts[3]] + bytes(100) + b"not a record " + gzip.compress(b"plain text") + data[starts[3] :]
    assert len(list(warc.records(reader(padded), len(padded), 0, len(padded)))) == 20


def test_archives_of_a_folder_with_payloads(spark, tmp_path):
    rows = spark.createDataFrame([(k, "http://a.example/é", bytes([k]) * (k * 1000), None if k % 2 else 0) for k in range(1, 9)], "page_id long, url string, payload binary, refers_to long")
    files = warc.written(rows.repartition(3), f"file://{tmp_path}/archives").collect()
    assert sum(f.records for f in files) == 8 and sorted(os.listdir(tmp_path / "archives")) == sorted(os.path.basename(f.path) for f in files)
    got = warc.read(warc.archives(spark, f"file://{tmp_path}/archives"), payloads=True, range_bytes=500).collect()
    assert {(r.record_id, r.record_type, r.payload_bytes, r.target_uri) for r in got} == {(f"<urn:page:{k}>", "response" if k % 2 else "revisit", k * 1000, "http://a.example/%C3%A9") for k in range(1, 9)}
    assert {r.record_id: r.payload for r in got if r.record_type == "response"} == {f"<urn:page:{k}>": bytes([k]) * (k * 1000) for k in range(1, 9, 2)}
    for f in files:  # any reader of gzip reads them
        with gzip.open(f.path.removeprefix("file://")) as g:
            assert g.read().count(b"WARC/1.1") == f.records

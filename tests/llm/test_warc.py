from __future__ import annotations

import gzip
import io
import random

import pytest

from archspark.llm.warc import GZIP_MAGIC, base32_sha1, read_archives, read_range, write_archives


def pages_of(spark, rows):
    return spark.createDataFrame([(a, b, c, "k", 1) for a, b, c in rows], "page_id long, url string, html string, keeper string, digest int")


@pytest.mark.parametrize("range_bytes", [97, 8 << 20])
def test_round_trip(spark, folder, range_bytes):
    rng = random.Random(1)
    texts = ["", "<p>é</p>", "x" * 5000, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(3000)), "a\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i} \n", rng.choice(texts)) for i in range(40)] + [(50, "u", None)]
    files = write_archives(pages_of(spark, rows), folder, file_bytes=4000)
    got = {int(r["page"]): r for r in read_archives(spark, folder, files, range_bytes).collect()}
    assert len(got) == len(rows)
    largest: dict = {}
    for page, _, text in rows:
        largest[text or ""] = max(page, largest.get(text or "", -1))
    for page, url, text in rows:
        r, payload = got[page], (text or "").encode()
        first = largest[text or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page else ("revisit", str(first)))
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base32_sha1(payload)
        assert r["payload"] == (bytearray(payload) if first == page else None)
        assert (r["url"] is None) == (url is None)


def test_smaller_payloads_repeats_and_empty_table(spark, folder):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (3, "u", "abcdef"), (2, "u", "abcdef"), (None, "u", "abcdef")]
    got = read_archives(spark, folder, write_archives(pages_of(spark, rows), folder, min_bytes=3)).collect()
    assert sorted((str(r["page"]), r["record_type"], r["refers_to"]) for r in got) == [
        ("1", "response", None), ("2", "response", None), ("2", "revisit", "3"), ("3", "response", None), ("3", "response", None), ("None", "revisit", "3"),
    ]
    empty = folder + "-empty"
    assert read_archives(spark, empty, write_archives(pages_of(spark, []), empty)).collect() == []


def test_false_magic_and_damage_are_passed_over():
    good = [gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nh%d\r\n\r\n" % i) for i in range(3)]
    broken = bytearray(good[0])
    broken[20] ^= 0xFF
    data = good[0] + GZIP_MAGIC + b"junk" + gzip.compress(b"no archive") + bytes(broken) + good[1] + good[2]
    assert [b for _, _, b in read_range(io.BytesIO(data), 0, len(data), len(data))] == [b"h0", b"h1", b"h2"]
    cut = data.index(good[1]) + 1
    assert [b for _, _, b in read_range(io.BytesIO(data), 0, cut, len(data))] == [b"h0", b"h1"]
    assert [b for _, _, b in read_range(io.BytesIO(data), cut, len(data), len(data))] == [b"h2"]


def test_damaged_archives_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://x.org/", f"<p>{i} " + "word " * 50 * i) for i in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/damaged"
    files = write_archives(pages, folder)
    assert read_archives(spark, folder, files).count() == 20
    target = next(p for p in sorted((tmp_path / "damaged").iterdir()) if p.stat().st_size > 200 and p.name in {r["name"].split("/")[-1] for r in files.collect()})
    data = bytearray(target.read_bytes())
    data[-20:] = b"\0" * 20
    target.write_bytes(bytes(data))
    with pytest.raises(Exception, match="breaks off|damaged|shorter"):
        read_archives(spark, folder, files).count()

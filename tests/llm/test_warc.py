import gzip
import random

import pytest

from larkspur.llm import warc


def archive(n=6, compress=True):
    return [warc.member(warc.record(i, f"http://x/{i}", f"page {i} ".encode() * (i + 1))) if compress else warc.record(i, None, b"WARC/1.1\r\nnot a record" * i) for i in range(n)]


def ids(rows):
    return [int(r[4]["warc-record-id"][len("<urn:page:") : -1]) for r in rows if r[0] == "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(compress):
    parts = archive(compress=compress)
    rows = list(warc.salvage(b"".join(parts)))
    assert ids(rows) == list(range(6)) and all(r[0] == "record" for r in rows) and sum(r[2] for r in rows) == sum(map(len, parts))


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_one_record(compress):
    parts = archive(compress=compress)
    for broken in (b"", b"garbage", parts[2][: len(parts[2]) // 2], bytes([parts[2][0] ^ 255]) + parts[2][1:]):
        rows = list(warc.salvage(b"".join([*parts[:2], broken, *parts[3:]])))
        assert ids(rows) == [0, 1, 3, 4, 5]
        gaps = [r for r in rows if r[0] == "gap"]
        assert len(gaps) == (1 if broken else 0) and sum(g[2] for g in gaps) == len(broken) and all(g[3] for g in gaps)


def test_any_damage_is_covered():
    rng, data = random.Random(1), b"".join(archive(8))
    for _ in range(60):
        bad = bytearray(data)
        at = rng.randrange(len(bad))
        bad[at : at + rng.randrange(1, 40)] = rng.randbytes(rng.randrange(0, 40))
        rows = list(warc.salvage(bytes(bad)))
        assert len(ids(rows)) >= 5
        end = 0
        for kind, offset, length, *_ in rows:
            assert offset in (end, end) and length >= 0
            end = offset + length
        assert end == len(bad)


def test_equal_payloads(spark):
    rows = [(1, "u", "a"), (5, "v", "a"), (3, None, "a"), (2, "w\r\nx", None), (4, "y", ""), (6, "z", "é"), (None, "n", "b"), (7, "m", "b"), (7, "m", "b")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, revisit string")
    back = warc.read_archives(warc.write_archives(warc.with_responses(pages))).where("kind = 'record'").collect()
    got = sorted((str(r["record_id"]), r["record_type"], r["payload_bytes"]) for r in back)
    urn = lambda n: f"<urn:page:{n}>"
    assert got == sorted([
        (urn(1), "revisit", 1), (urn(5), "response", 1), (urn(3), "revisit", 1), (urn(2), "revisit", 0), (urn(4), "response", 0), (urn(6), "response", 2), ("None", "revisit", 1), (urn(7), "response", 1), (urn(7), "response", 1),
    ])
    small = warc.with_responses(pages, min_revisit_bytes=2).where("revisit")
    assert small.count() == 0 and warc.with_responses(pages.limit(0)).count() == 0
    assert warc.read_archives(spark.createDataFrame([("a", None), ("b", b""), ("c", b"junk")], "path string, content binary")).collect()[0]["kind"] == "gap"


def http_record(payload, digest_of, block=None):
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Type: application/http; msgtype=response\r\n"
    head += f"WARC-Payload-Digest: sha1:{warc.digest(digest_of)}\r\n" + (f"WARC-Block-Digest: sha1:{warc.digest(block)}\r\n" if block else "")
    return f"{head}Content-Length: {len(message)}\r\n\r\n".encode() + message + b"\r\n\r\n", message


def test_http_records():
    body = b"<html>hi</html>"
    data, message = http_record(body, body)
    assert [(r[0], r[5]) for r in warc.salvage(warc.member(data))] == [("record", body)]
    assert [r[3] for r in warc.salvage(http_record(body, b"other")[0])] == ["digest"]
    assert [r[0] for r in warc.salvage(http_record(body, b"decoded", message)[0])] == ["record"]  # the block's digest decides
    assert [r[3] for r in warc.salvage(http_record(body, body, b"other")[0])] == ["digest"]
    assert b"WARC-Date: 2024-01-01T00:00:00Z\r\n" in warc.record(1, "u", b"x", date="2024-01-01T00:00:00Z")


def test_archive_that_is_one_member():
    records = archive(20, compress=False)
    assert ids(warc.salvage(gzip.compress(b"".join(records)))) == list(range(20))
    records[7] = records[7].replace(b"not", b"nOt", 1)
    rows = list(warc.salvage(gzip.compress(b"".join(records))))
    assert ids(rows) == [i for i in range(20) if i != 7]
    assert [(r[1], r[3], r[7]) for r in rows if r[0] == "gap"] == [(0, "digest", len(records[7]))]
    whole = gzip.compress(b"".join(warc.record(i, None, random.Random(i).randbytes(20_000)) for i in range(50)))
    rows = list(warc.salvage(whole[: len(whole) // 2] + b"".join(archive(3))))
    assert ids(rows)[:20] == list(range(20)) and ids(rows)[-3:] == [0, 1, 2] and [r[3] for r in rows if r[0] == "gap"] == ["gzip"]


def test_pieces_are_read_like_the_whole(spark):
    data = b"x" * 90_000 + b"".join(archive(8)) + b"WARC/1.0\r\nbroken" + b"".join(archive(4, False)) + b"\x1f\x8b\x08"
    want = [r[:4] for r in warc.salvage(data)]
    for size in (7, 1000, 65_536):
        assert [r[:4] for r in warc.salvage(data[i : i + size] for i in range(0, len(data), size))] == want
    parts = [(p, i // 5000, bytearray(data[i : i + 5000])) for p in ("a", "b") for i in range(0, len(data), 5000)]
    random.Random(0).shuffle(parts)
    rows = warc.read_archives(spark.createDataFrame(parts, "path string, part int, content binary")).collect()
    assert sorted((r["path"], r["kind"], r["offset"], r["length"], str(r["reason"])) for r in rows) == sorted((p, *w[:3], str(w[3])) for p in ("a", "b") for w in want)


def test_damaged_archives_through_spark(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(300)] + [(900, "long", "y" * 3_000_000)], "page_id long, url string, html string")
    archives = warc.materialize(warc.write_archives(warc.with_responses(pages).coalesce(1)))
    back = warc.read_archives(warc.broken_off(archives)).collect()
    assert sorted(len(r["payload"]) for r in back if r["kind"] == "record")[-1] == 3_000_000 and sum(r["kind"] == "record" for r in back) == 301
    gaps = [r for r in back if r["kind"] == "gap"]
    assert len(gaps) == 2 * archives.count() and all(g["length"] == 100 and g["reason"] for g in gaps)
    content = archives.first()["content"]
    cut = bytes(content[: len(content) // 3]) + bytes(content[len(content) // 3 + 10 :])
    rows = warc.read_archives(spark.createDataFrame([("c", bytearray(cut))], "path string, content binary")).collect()
    assert sum(r["kind"] == "record" for r in rows) in (300, 299) and any(r["kind"] == "gap" for r in rows)

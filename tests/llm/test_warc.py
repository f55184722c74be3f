"""WARC files written and read back, filters, foreign files and edge cases."""

from __future__ import annotations

import gzip
import hashlib
import io

from pyspark.sql import functions as F

from tidepanel.llm import warc as W

PAGES = "page_id long, url string, html string, payload string"


def rows():
    big, small = "x é" * 600, "tiny"
    return [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, big), (2, "http://b/ 2", small), (3, "u", small), (5, "u", None), (6, "u", ""), (None, "n", "own " * 400), (7, "u", "y" * 1000), (7, "u", "y" * 1000)]


def expected():
    out = []
    data = [(p, u, (h or "").encode()) for p, u, h in rows()]
    for p, _, b in data:
        best = max((q for q, _, c in data if c == b and q is not None), default=None)
        revisit = len(b) >= 1000 and sum(c == b for _, _, c in data) > 1 and p != best
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], PAGES).repartition(3)
    W.write_warc(W.page_records(df), f"file://{tmp_path}/w")
    back = W.read_warc(spark, f"file://{tmp_path}/w").cache()
    got = [(r["p"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["t"]) for r in back.withColumn("p", W.page_of("record_id")).withColumn("t", W.page_of("refers_to")).collect()]
    assert sorted(got, key=str) == expected()
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in back.filter("record_type = 'response'").collect())
    assert back.filter("record_type = 'revisit' and payload is not null").count() == 0


def test_filters_are_pushed_and_right(spark, tmp_path):
    W.write_warc(W.page_records(spark.createDataFrame([(*r, "c") for r in rows()], PAGES)), str(tmp_path / "w"))
    heads = W.read_warc(spark, str(tmp_path / "w"), payloads=False)
    assert "payload" not in heads.columns
    both = heads.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http"))
    assert [r["record_id"] for r in both.collect()] == ["urn:page:1"]
    reader = W.WarcReader(str(tmp_path / "w"), heads.schema, 1)
    assert list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("record_date",), 1)])) == [W.EqualTo(("record_date",), 1)]


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    row = {"record_id": "a", "record_type": "response", "target_uri": "u", "record_date": None, "payload_digest": None, "payload_bytes": None, "refers_to": None, "payload": bytes(range(256)) * 4000}
    data = W.member(W.record(row)) + W.member(W.record({**row, "record_id": "b"}))
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    inflated = []
    real = W.Member.parts
    monkeypatch.setattr(W.Member, "parts", lambda self: (inflated.append(len(p)) or p for p in real(self)))
    got = list(W.records(io.BufferedReader(io.BytesIO(data)), lambda r: r["record_id"] == "c", True))
    assert got == [] and sum(inflated) < 20_000


def test_foreign_files(spark, tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    one = head % len(http) + http + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 2)
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 5 and {bytes(r["payload"]) for r in got} == {b"hello"} and {r["payload_bytes"] for r in got} == {5}


def test_records_without_http(spark, tmp_path):
    """The payload of other records is their whole block; a date that is none is null; folders inside and single files are read."""
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%s>\r\nWARC-Date: %s\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n"
    body = b"first part\r\n\r\nsecond part"
    kinds = [(b"warcinfo", b"application/warc-fields"), (b"conversion", b"text/plain"), (b"metadata", b"application/json"), (b"resource", b"text/html")]
    data = [head % (k, k, b"yesterday" if k == b"metadata" else b"2020-01-02T03:04:05Z", t, len(body)) + body + b"\r\n\r\n" for k, t in kinds]
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "c.warc").write_bytes(data[0])
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {bytes(r["payload"]) for r in got} == {body} and {r["payload_bytes"] for r in got} == {len(body)}
    assert {r["record_type"] for r in got if r["record_date"] is None} == {"metadata"}
    assert W.read_warc(spark, str(tmp_path / "b.warc.gz"), payloads=False).filter("record_type = 'conversion'").count() == 1


def test_small_files_are_read_by_several_tasks(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * 100)
    reader = W.WarcReader(str(tmp_path), spark.range(0).schema, 4)
    assert [len(p.paths) for p in reader.partitions()] == [1, 1, 1, 1, 1, 1]


def test_empty(spark, tmp_path):
    W.write_warc(W.page_records(spark.createDataFrame([], PAGES)), str(tmp_path / "e"))
    assert W.read_warc(spark, str(tmp_path / "e")).collect() == []


def some_records(n=4):
    base = {"record_type": "response", "target_uri": "u", "record_date": None, "payload_digest": None, "payload_bytes": None, "refers_to": None}
    return [{**base, "record_id": f"r{k}", "payload": bytes([65 + k]) * (70_000 * k + 3)} for k in range(n)]


def read(data, payloads=True, keep=lambda r: True):
    return [(r["record_id"], r["record_type"], hashlib.sha1(r.get("payload") or b"").hexdigest()) for r in W.records(io.BufferedReader(io.BytesIO(data)), keep, payloads)]


def test_archives_of_all_common_forms():
    rows = some_records()
    plain = [W.record(r) for r in rows]
    want = [(r["record_id"], "response", hashlib.sha1(r["payload"]).hexdigest()) for r in rows]
    checked = bytearray(gzip.compress(plain[1]))
    checked[3] |= 2  # a header checksum
    checked[10:10] = b"\x12\x34"
    forms = {
        "plain": b"".join(plain),
        "one member each": b"".join(map(gzip.compress, plain)),
        "sl members": b"".join(map(W.member, plain)),
        "two in a member": gzip.compress(plain[0] + plain[1]) + gzip.compress(plain[2] + plain[3]),
        "two in an sl member": W.member(plain[0] + plain[1]) + W.member(plain[2] + plain[3]),
        "all in one member": gzip.compress(b"".join(plain)),
        "header checksum": gzip.compress(plain[0]) + bytes(checked) + gzip.compress(plain[2]) + W.member(plain[3]),
        "padding": b"".join(map(gzip.compress, plain)) + b"\0" * 200_000,
        "blank lines": b"\r\n\n".join([b"", *plain, b""]),
        "blank lines in a member": gzip.compress(b"\r\n\r\n".join([b"", *plain])),
        "mixed": plain[0] + gzip.compress(plain[1] + plain[2]) + b"\n" + plain[3],
    }
    for name, data in forms.items():
        assert read(data) == want, name
        assert [r[0] for r in read(data, payloads=False)] == [w[0] for w in want], name
        assert [r[0] for r in read(data, keep=lambda r: r["record_id"] in ("r0", "r3"))] == ["r0", "r3"], name


def test_a_cut_record_ends_its_file_and_is_told():
    rows = some_records(3)
    plain = [W.record(r) for r in rows]
    whole = [(r["record_id"], "response", hashlib.sha1(r["payload"]).hexdigest()) for r in rows[:2]]
    for pack in (bytes, gzip.compress, W.member):
        first, last = pack(plain[0]) + pack(plain[1]), pack(plain[2])
        for size in (len(last) - 30, len(last) // 2):
            assert read(first + last[:size]) == [*whole, ("r2", "cut", hashlib.sha1(b"").hexdigest())], pack
            assert read(first + last[:size], keep=lambda r: r["record_type"] == "response") == whole
        assert read(first + last[:12])[:2] == whole and len(read(first + last[:12])) <= 3
    together = gzip.compress(b"".join(plain))
    assert read(together[: len(together) - 20])[:2] == whole
    assert read(b"") == read(b"\0\0\0") == read(b"\x1f") == []

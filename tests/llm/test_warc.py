"""Archives written and read back."""

import hashlib
import random

import pytest
from llm import warc


def rows_of(seed):
    rng = random.Random(seed)
    blob = lambda n: bytes(rng.choice(b"ab\r\n W/1.:") for _ in range(n))
    big = blob(5000)
    rows = [(i, f"http://x/{i}", blob(rng.choice((0, 1, 10, 999, 1000, 64, 128)))) for i in range(20)]
    rows += [(30, "u", big), (31, None, big), (32, "a b\r\nc", big), (33, "u", b"\r\n" * 600), (34, "u", "é".encode() * 700), (35, "u", None), (36, "u", b"WARC/1.1\r\n\r\n"), (37, "u", blob(64 * 3)), (None, "u", big), (30, "u", big)]
    return rows


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_round_trip(spark, tmp_path, chunk):
    rows = rows_of(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, url string, payload binary, size string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, chunk_bytes=chunk)
    got = sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(spark, path).collect()), key=str)
    top = {}
    for i, _, p in rows:
        if i is not None and p and len(p) >= 1000:
            top[p] = max(top.get(p, i), i)
    want = []
    for i, _, p in rows:
        p = p or b""
        back = i is not None and top.get(p, i) > i
        want.append((f"urn:record:{'null' if i is None else i}", "revisit" if back else "response", len(p), hashlib.sha1(p).hexdigest(), f"urn:record:{top[p]}" if back else None))
    assert got == sorted(want, key=str)
    whole = {}
    for r in sorted(warc.read_chunks(spark, path).where("record_id <> 'urn:record:30'").collect(), key=lambda r: (r.record_id, r.chunk_no)):
        assert len(r.chunk) <= chunk
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.chunk)
        assert hashlib.sha1(whole[r.record_id]).hexdigest() == r.running_digest
    assert whole["urn:record:37"] == next(p for i, _, p in rows if i == 37)


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "id long, url string, payload binary"), str(tmp_path / "w"))
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 0


def foreign(tmp_path, *records, name="f.warc"):
    folder = tmp_path / "foreign"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"".join(b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n" for head, body in records))
    return str(folder)


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + b"x\r\n" * 500
    path = foreign(
        tmp_path,
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:a>")], b"software: x\r\n"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:b>"), ("WARC-Target-URI", "http://x")], http),
        ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:c>"), ("WARC-Refers-To", "<urn:b>")], b""),
        ([("WARC-Record-ID", "<urn:d>"), ("WARC-Payload-Digest", "sha1:ABC")], b""),
    )
    got = {r.record_id: r for r in warc.read_records(spark, path).collect()}
    assert set(got) == {"urn:a", "urn:b", "urn:c", "urn:d"}
    assert (got["urn:b"].payload_digest, got["urn:b"].payload_bytes, got["urn:b"].declared_digest) == (hashlib.sha1(http).hexdigest(), len(http), None)
    assert (got["urn:c"].payload_bytes, got["urn:c"].payload_digest, got["urn:c"].refers_to) == (None, None, "urn:b")
    assert (got["urn:d"].record_type, got["urn:d"].declared_digest) == (None, "ABC")
    chunks = sorted((r for r in warc.read_chunks(spark, path, chunk_bytes=64).collect() if r.record_id == "urn:b"), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.chunk) for r in chunks) == http and all(len(r.chunk) <= 64 for r in chunks) and [r.chunk_no for r in chunks] == list(range(len(chunks)))
    assert chunks[-1].running_digest == hashlib.sha1(http).hexdigest()


def test_a_cut_archive_is_an_error(spark, tmp_path):
    path = foreign(tmp_path, ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:b>")], b"abc" * 100))
    file = tmp_path / "foreign" / "f.warc"
    file.write_bytes(file.read_bytes()[:-150])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, path).collect()


def test_chunk_table(spark):
    rows = rows_of(2)
    got = warc.chunk_table(spark.createDataFrame(rows, "id long, url string, payload binary").repartition(3), 100).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (str(r.id), r.digest, r.number)):
        if r.id == 30:  # two equal rows
            continue
        whole[r.id] = whole.get(r.id, b"") + bytes(r.body)
        assert len(r.body) <= 100 and hashlib.sha1(whole[r.id]).hexdigest() == r.running_digest
    assert all(whole[i] == (p or b"") for i, _, p in rows if i != 30)

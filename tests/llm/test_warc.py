import base64
import hashlib

from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import warc as W

HEAD = "HTTP/1.1 200 OK\r\nContent-Type: {}\r\nX-A: 1\r\n 2\r\nX-A: 3\r\n\r\n"
ROWS = [
    ("<urn:r1>", "http://a/1", "2024-01-01T00:00:00Z", HEAD.format("text/html; charset=utf-8") + "<p>A &amp; b</p><script>x</script><p>\u00e9"),
    ("<urn:r2>", "http://a/2", None, HEAD.format("text/plain") + "as  it\nis"),
    ("<urn:r3>", None, "2024-01-01T00:00:00Z", HEAD.format("image/png") + "\u0000\u0001"),
    ("<urn:r4>", "http://a/4", "d", "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>gone"),
    ("<urn:r5>", "http://a/5", "d", "<p>no header</p>"),
    (None, "http://a/6", "d", None), ("<urn:r7>", "http://a/7", "d", ""),
    ("<urn:r1>", "http://a/1", "2024-01-01T00:00:00Z", HEAD.format("text/html; charset=utf-8") + "<p>A &amp; b</p><script>x</script><p>\u00e9"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "record_id string, target_uri string, warc_date string, block string, headers string")


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_records_links_and_digests(spark):
    out = W.derivatives(frame(spark)).collect()
    by = {}
    for r in out:
        h = {x["name"]: x["value"] for x in r["headers"]}
        assert h["WARC-Record-ID"] == r["record_id"] and h["WARC-Type"] == r["record_type"] and h["WARC-Refers-To"] == r["refers_to"]
        assert h["WARC-Block-Digest"] == sha1(r["block"]) and int(h["Content-Length"]) == len(r["block"])
        assert h.get("WARC-Target-URI") == r["target_uri"] and h.get("WARC-Date") == r["warc_date"]
        by.setdefault((r["refers_to"], r["record_type"]), []).append((r, h))
    conv, meta = by["<urn:r1>", "conversion"], by["<urn:r1>", "metadata"]
    assert len(conv) == 2 and conv[0][0] == conv[1][0]                     # repeated responses, repeated records
    assert conv[0][0]["block"].decode() == "A & b\n\u00e9" and meta[0][1]["WARC-Concurrent-To"] == conv[0][0]["record_id"]
    assert meta[0][1]["WARC-Source-Payload-Digest"] == sha1(ROWS[0][3].partition("\r\n\r\n")[2].encode())
    for line in ("http-status: HTTP/1.1 200 OK", "http-x-a: 1 2", "http-x-a: 3", "payload-type: text/html"):
        assert line + "\r\n" in meta[0][0]["block"].decode()
    assert by["<urn:r2>", "conversion"][0][0]["block"] == b"as  it\nis"
    for r in ("<urn:r3>", "<urn:r4>"):
        assert (r, "conversion") not in by and (r, "metadata") in by
    assert by["<urn:r5>", "conversion"][0][0]["block"] == b"no header" and by["<urn:r7>", "conversion"][0][0]["block"] == b""
    assert sum(k == "metadata" for _, k in by) == 7
    assert len({r["record_id"] for r in out}) == len({(r["refers_to"], r["record_type"]) for r in out})
    assert W.derivatives(frame(spark).limit(0)).count() == 0


def test_files_hold_every_record(spark, tmp_path):
    records = W.derivatives(frame(spark))
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        W.write_warc(records, path, compression)
        back = W.read_warc(spark, path)
        assert back.where("NOT complete").count() == 0
        assert back.select(*W._NAMES).exceptAll(records.select(*W._NAMES)).count() == 0 and back.count() == records.count()


def test_pages_become_responses(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (2, None, None), (None, "u", "<b>y")], "page_id long, url string, html string")
    out = W.digests(W.derivatives(W.page_responses(pages))).collect()
    assert len(out) == 6 and all(r["block_digest"].startswith("sha1:") for r in out)


def raw_record(version, kind, n, block, length=None, more=""):
    return (f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{n}>\r\n{more}"
            f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def read(spark, path):
    W.prepare(spark)
    return {r["record_id"]: r for r in W.read_warc(spark, str(path)).collect()}


def test_three_records_of_either_version(spark, tmp_path):
    for v in ("1.0", "1.1"):
        f = tmp_path / f"{v}.warc"
        f.write_bytes(b"".join(raw_record(v, "response", k, f"block {k}".encode()) for k in range(3)))
        got = read(spark, f)
        assert {k: r["block"] for k, r in got.items()} == {f"<urn:{k}>": f"block {k}".encode() for k in range(3)}
        assert all(r["complete"] for r in got.values())


def test_a_version_line_within_a_block_survives(spark, tmp_path):
    inner = raw_record("1.0", "response", "inner", b"x" * 20)
    blocks = [b"before\r\n\r\nWARC/1.1\r\nafter", inner + inner, b"\r\n\r\nWARC/1.", b"", b"\r\n\r\n", b"plain", b"\r\n\r\nWARC/1.0\r\nContent-Length: 900\r\n\r\n"]
    data = b"".join(raw_record("1.0" if k % 2 else "1.1", "response", k, b) for k, b in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(data)
    import gzip
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(raw_record("1.0", "response", f"z{k}", b)) for k, b in enumerate(blocks)))
    got = read(spark, tmp_path)
    assert {k: r["block"] for k, r in got.items()} == {f"<urn:{p}{k}>": b for p in ("", "z") for k, b in enumerate(blocks)}
    assert all(r["complete"] for r in got.values())


def test_records_over_many_splits_of_one_file(spark, tmp_path):
    blocks = [(f"{k} " * 400).encode() + (b"\r\n\r\nWARC/1.0\r\nWARC-Type: fake\r\n\r\n" if k % 7 == 0 else b"") + bytes([k % 256]) * 300 for k in range(300)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw_record("1.0", "response", k, b) for k, b in enumerate(blocks)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read(spark, tmp_path / "a.warc")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: r["block"] for k, r in got.items()} == {f"<urn:{k}>": b for k, b in enumerate(blocks)}


def test_a_record_cut_off_is_not_complete(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw_record("1.0", "response", 1, b"whole") + raw_record("1.0", "response", 2, b"short", 500))
    got = read(spark, tmp_path / "a.warc")
    assert got["<urn:1>"]["complete"] and not got["<urn:2>"]["complete"] and got["<urn:2>"]["block"].startswith(b"short")
    (tmp_path / "empty.warc").write_bytes(b"")
    assert read(spark, tmp_path / "empty.warc") == {}


def test_latin_1_payload_keeps_its_digest_and_source_headers_are_carried(spark, tmp_path):
    payload = "<p>caf\u00e9 \u00fcber".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n" + payload
    more = ("WARC-Target-URI: http://a/\r\nWARC-Date: d\r\nWARC-IP-Address: 192.0.2.1\r\nWARC-Warcinfo-ID: <urn:info>\r\n"
            "WARC-Payload-Digest: sha1:DECLARED\r\nWARC-Block-Digest: sha1:BLOCK\r\n")
    (tmp_path / "a.warc").write_bytes(raw_record("1.0", "response", 1, block, more=more) + raw_record("1.0", "response", 2, block))
    W.prepare(spark)
    out = {(r["refers_to"], r["record_type"]): r for r in W.derivatives(W.read_warc(spark, str(tmp_path / "a.warc"))).collect()}
    head = {k: {h["name"]: h["value"] for h in r["headers"]} for k, r in out.items()}
    for n in ("<urn:1>", "<urn:2>"):
        assert out[n, "conversion"]["block"].decode() == "caf\u00e9 \u00fcber"
        assert head[n, "conversion"]["WARC-Source-Payload-Digest"] == ("sha1:DECLARED" if n == "<urn:1>" else sha1(payload))
        assert f"payload-length: {len(payload)}\r\n" in out[n, "metadata"]["block"].decode()
    assert head["<urn:1>", "metadata"]["WARC-Source-Block-Digest"] == "sha1:BLOCK" and head["<urn:1>", "conversion"]["WARC-Warcinfo-ID"] == "<urn:info>"
    for line in ("source-warc-ip-address: 192.0.2.1", "source-warc-payload-digest: sha1:DECLARED", f"source-content-length: {len(block)}"):
        assert line + "\r\n" in out["<urn:1>", "metadata"]["block"].decode()
    assert "WARC-Source-Block-Digest" not in head["<urn:2>", "metadata"]


def test_binary_blocks_come_back_as_they_are(spark, tmp_path):
    blocks = [bytes(range(256)), b"\xff\xfe\r\n\r\n\x00", "\u00e9".encode("latin-1")]
    rows = [(f"<urn:{k}>", "resource", None, None, None, [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:{k}>"), ("Content-Length", str(len(b)))], bytearray(b))
            for k, b in enumerate(blocks)]
    W.write_warc(spark.createDataFrame(rows, W.RECORD), str(tmp_path / "w"))
    assert {k: bytes(r["block"]) for k, r in read(spark, tmp_path / "w").items()} == {f"<urn:{k}>": b for k, b in enumerate(blocks)}


def test_charsets():
    assert W.decoded("\u0434".encode("cp1251"), "text/html; charset=windows-1251") == "\u0434"
    assert W.decoded("\u00e9".encode(), 'text/html; charset="UTF-8"') == "\u00e9"
    for bad in ("text/html; charset=nonsense", "text/html; charset=base64", "text/html; charset=", ""):
        assert W.decoded("\u00e9".encode(), bad) == "\u00e9"
    assert W.decoded(b"\xff", "text/html") == "\ufffd"

import base64
import glob
import gzip
import hashlib

import pytest

from flowlattice.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_arc_versions_round_trip():
    contents = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nhttp://x 0.0.0.0 20000101000000 text/html 4\n", b"", b"\n\n", b"raw \xff bytes"]
    for version in (1, 2):
        arc = warc.write_arc("a.arc", version, [("http://a b/é", "20240102030405", "text/html", c) for c in contents])
        first, *rest = warc.read_arc(arc)
        assert first.fields[b"URL"] == b"filedesc://a.arc" and [r.content for r in rest] == contents
        assert len(first.fields) == {1: 5, 2: 10}[version]
        assert all(b" " not in r.fields[b"URL"] for r in rest)
        out = list(warc.convert(arc, "a.arc"))
        assert [w.headers["WARC-Type"] for w in out] == ["warcinfo", "response", "resource", "resource", "resource"]
        assert out[1].headers["WARC-Date"] == "2024-01-02T03:04:05Z"
        assert out[1].headers["WARC-Payload-Digest"] == "sha1:" + digest(contents[0].partition(b"\r\n\r\n")[2])
        assert len({w.headers["WARC-Record-ID"] for w in out}) == 5
        data = b"".join(w.to_bytes() + b"\r\n\r\n" for w in out)
        for step in (1, 7, len(data)):
            pieces = (data[at : at + step] for at in range(0, len(data), step))
            assert [r.block for r in warc.read_warc(pieces)] == [w.block for w in out]
        with pytest.raises(ValueError):
            list(warc.read_warc(iter([data[:-9]])))


def test_members_are_plain_gzip():
    records = [b"a" * 10, b"", bytes(range(256)) * 80_000]
    packed = b"".join(m for r in records for m in warc.members(r))
    assert gzip.decompress(packed) == b"".join(records) and packed[-1] == 0
    assert all(m[-1] == 0 for r in records for m in warc.members(r))
    assert b"".join(warc.unpacked(memoryview(packed), 100)) == b"".join(records)


@pytest.mark.parametrize("broken", [b"filedesc://x 0.0.0.0 2000 text/plain 9", b"http://x 0.0.0.0 2000 text/plain 0\n", b"filedesc://x 0 2000 text/plain 4\n9 0 \n\n", b"filedesc://x 0 2000 text/plain 400\n1 0 a\nURL\n"])
def test_malformed_archives_raise(broken):
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(broken))


def test_short_dates():
    assert warc.timestamp(b"2003") == "2003-01-01T00:00:00Z"
    assert warc.timestamp(b"2003050607") == "2003-05-06T07:00:00Z"
    with pytest.raises(warc.ArcError):
        warc.timestamp(b"20x3")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def test_pages_come_back(spark):
    rows = [(i, f"http://h/{i}", "hot \r\n\r\npage" if i % 3 == 0 else f"<p>{i % 40}</p>" * (i % 7), "clash") for i in range(300)]
    rows += [(500, None, None, None), (501, "", "", None), (502, "http://a b\n", "WARC/1.0\r\n\r\n", "x" * 10), (7, "http://h/7", rows[7][2], "again"), (None, "u", "no id", "")]
    df = pages(spark, rows)
    for floor in (0, 10):
        got = warc.read_archives(spark, warc.write_archives(df, min_bytes=floor, segment_records=20, segments_per_file=2)).collect()
        first = {}
        for i, _, h, _ in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want = []
        for i, _, h, _ in rows:
            body = (h or "").encode()
            other = first.get(h or "") if i is not None and len(body) >= floor else None
            again = other is not None and other != i
            want.append((i, len(body), digest(body), "revisit" if again else "response", other if again else None))
        assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)


def test_files_hold_a_member_a_record(spark):
    rows = [(i, f"http://h/{i}", "x" * 1000 * (i + 1), "20240102030405" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(1)
    folder = warc.write_archives(df, date_col="digest", segment_bytes=50_000, segments_per_file=3)
    files = [f for f in glob.glob(folder.removeprefix("file://") + "/part-*")]
    assert len(files) > 3
    for name in files:
        with open(name, "rb") as f:
            data = f.read()
        records = list(warc.read_warc(iter([gzip.decompress(data)])))
        assert records[0].headers["WARC-Type"] == "warcinfo" and data.count(b"\x1f\x8b\x08") >= len(records)
    dates = {r.page_id: r.warc_date for r in warc.read_archives(spark, folder).collect()}
    assert dates[1] == "2024-01-02T03:04:05Z" and dates[2] != dates[1] and len(dates) == 40


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(df)).count() == 0

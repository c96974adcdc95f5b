"""ZIP packages and WARC records: other writers' packages, broken ones, hostile pages, brute force."""

from __future__ import annotations

import gzip
import io
import json
import random
import zipfile

import pytest

from cashtide.llm import archives, warc_records, zip_packages

PAGES = "page_id long, url string, html string, record_type string, refers_to string, _key string"
RULE = "page_id, payload_bytes, payload_digest, record_type, refers_to"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def by_hand(rows, least=0):
    groups, found = {}, []
    for n, (i, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((i is None, i or 0, n))
    for n, (i, _, html) in enumerate(rows):
        payload = (html or "").encode()
        first = min(groups[html or ""])
        revisits = len(payload) >= least and first[2] != n
        refers = None if not revisits or first[0] else first[1]
        found.append((i, len(payload), warc_records.base32_sha1(payload), "revisit" if revisits else "response", refers))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def hostile():
    long_text = "".join(random.Random(1).choice("<p>aé日\n ") for _ in range(400_000))
    rows = [(5, "http://a.org/x", None), (3, None, ""), (None, "", "lost"), (None, "http://b.org", "lost"), (8, "u\r\nWARC-Type: x\x00", "é👍")]
    rows += [(7, "http://c.org/1", long_text), (6, "http://c.org/2", long_text), (6, "http://c.org/3", long_text)]
    return rows + [(1, "http://hot.org", "hot")] * 60 + [(i, "http://hot.org", "hot") for i in range(20, 80)]


@pytest.mark.parametrize("wide", [False, True])
def test_round_trip_of_hostile_pages(spark, tmp_path, hostile, wide):
    packages = archives.write(table(spark, hostile).repartition(3), str(tmp_path / "p"), wide=wide, limit=20_000)
    found = archives.read(packages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == by_hand(hostile)
    texts = {r.page_id: r.payload.decode() for r in found if r.record_type == "response"}
    assert texts[6] == dict((i, h) for i, _, h in hostile)[6] and texts[8] == "é👍"
    assert all(r.intact for r in found if r.record_type == "response")
    assert sum(r.records for r in packages.collect()) == len(hostile)
    names = [r.package for r in packages.collect()]
    assert len(names) == len(set(names)) > 3
    for name in names:  # another reader takes them too
        whole = zipfile.ZipFile(zip_packages.opened(name)[1])
        assert whole.testzip() is None and all(x.compress_type == zipfile.ZIP_STORED for x in whole.infolist())
        assert gzip.decompress(whole.read(archives.ARCHIVE)).startswith(b"WARC/1.1\r\n")


def test_small_payloads_stay_responses(spark, hostile):
    found = archives.round_trip(table(spark, hostile), least=4).select(*RULE.split(", ")).collect()
    assert sorted((tuple(r) for r in found), key=str) == by_hand(hostile, least=4)


def test_no_pages_no_packages(spark, tmp_path):
    packages = archives.write(table(spark, []), str(tmp_path / "none"))
    assert packages.count() == 0 and archives.read(packages).count() == 0


def zipped(tmp_path, name, contents, **how):
    """A package by the standard library, with bytes in front of it and a comment behind it."""
    path = tmp_path / name
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", **how) as out:
        for member, data, method in contents:
            with out.open(zipfile.ZipInfo(member) if method == zipfile.ZIP_STORED else _packed(member), "w", force_zip64=how.get("allowZip64", False)) as file:
                file.write(data)
        out.comment = b"a comment with PK\x05\x06 in it"
    path.write_bytes(b"#!front\n" + held.getvalue())
    return str(path)


def _packed(member):
    info = zipfile.ZipInfo(member)
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


def records(n, packed):
    made = [warc_records.page_record(f"text {i} ".encode() * i, f"<urn:x:{i}>", archives.NO_DATE, f"http://x.org/{i}", i, False, None) for i in range(n)]
    return made if packed else [gzip.decompress(x) for x in made]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("wide", [True, False])
def test_archives_without_an_index_are_walked(spark, tmp_path, packed, wide):
    name = "archive/more.warc" + ".gz" * packed
    path = zipped(tmp_path, f"w{packed}{wide}.zip", [("other.bin", b"PK\x01\x02" * 9, 0), (name, b"".join(records(30, packed)), 0)], allowZip64=wide)
    found = archives.read(spark.createDataFrame([(path,)], "package string")).orderBy("page_id").collect()
    assert [(r.page_id, r.payload.decode()) for r in found] == [(i, f"text {i} " * i) for i in range(30)]
    assert {r.member for r in found} == {name}


@pytest.mark.parametrize("index", ["indexes/index.cdxj", "indexes/index.cdx.gz"])
def test_indexes_may_be_packed(spark, tmp_path, index):
    parts, lines, at = records(12, True), [], 0
    for part in parts:
        lines.append("x 0 " + json.dumps({"filename": "data.warc.gz", "offset": str(at), "length": str(len(part))}))
        at += len(part)
    text = "\n".join(["!meta without an entry", *lines]).encode()
    text = gzip.compress(text[:40]) + gzip.compress(text[40:]) if index.endswith("gz") else text
    path = zipped(tmp_path, "packed.zip", [(index, text, zipfile.ZIP_DEFLATED), ("archive/data.warc.gz", b"".join(parts), 0)])
    found = archives.read(spark.createDataFrame([(path,)] * 2, "package string"), payloads=False).collect()
    assert sorted(r.page_id for r in found) == sorted([*range(12)] * 2) and all(r.payload is None for r in found)


def test_only_ranges_are_read(tmp_path):
    """A package of 8 MB: one record is found and read by less than a megabyte of ranges."""
    parts = records(40, True)
    stuff = ("filler.bin", random.Random(2).randbytes(8 << 20), 0)
    path = zipped(tmp_path, "large.zip", [("archive/data.warc.gz", b"".join(parts), 0), stuff])
    source, asked = zip_packages.Ranges(path), []
    file = source.file

    class Counting:
        def read_at(self, length, offset):
            asked.append(length)
            return file.read_at(length, offset)

    source.file = Counting()
    member, start, size, offset, length = list(archives.index_entries(source))[-1]
    assert archives.read_record(source, start, size, offset, length, True)[2] == 39
    assert sum(asked) < 4 * zip_packages.WINDOW


def test_broken_packages_are_named(tmp_path):
    good = zipped(tmp_path, "good.zip", [("archive/data.warc.gz", b"".join(records(3, True)), 0)])
    data = open(good, "rb").read()
    for name, bytes_ in (("cut", data[:-60]), ("empty", b""), ("text", b"not a package" * 9)):
        path = tmp_path / f"{name}.zip"
        path.write_bytes(bytes_)
        with pytest.raises(zip_packages.PackageError, match=name):
            list(archives.index_entries(zip_packages.Ranges(str(path))))
    deflated = zipped(tmp_path, "deflated.zip", [("archive/data.warc.gz", b"x" * 99, zipfile.ZIP_DEFLATED)])
    with pytest.raises(zip_packages.PackageError, match="no ranges"):
        list(archives.index_entries(zip_packages.Ranges(deflated)))
    with pytest.raises(zip_packages.PackageError, match="here"):
        warc_records.parsed(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort", "here")


def test_many_members_need_zip64(tmp_path):
    path = tmp_path / "many.zip"
    path.write_bytes(zip_packages.package((f"m{i}", b"x") for i in range(70_000)))
    source = zip_packages.Ranges(str(path))
    assert sum(1 for _ in zip_packages.members(source)) == zip_packages.directory(source).entries == 70_000

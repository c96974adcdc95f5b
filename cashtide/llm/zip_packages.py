"""ZIP packages read by ranges: directories are parsed, stored members are located, nothing is extracted.

A package is read through ``Ranges``, which asks its file system for byte ranges only. The end record, its ZIP64
counterpart and the central directory say where members are; a stored member's bytes stand in the package as they
are, so a record inside of it is one more range. Packages that are written here have stored members only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs


class Layout:
    """A struct layout that may travel to tasks."""

    def __init__(self, form: str):
        self.form, self.size = form, struct.calcsize(form)

    def pack(self, *values) -> bytes:
        return struct.pack(self.form, *values)

    def unpack(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.form, data, at)


# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM = Layout("<4s5H3L2H")
CENTRAL_FORM = Layout("<4s6H3L5H2L")
END_FORM = Layout("<4s4H2LH")
END64_FORM = Layout("<4sQ2H2L4Q")
LOCATOR64_FORM = Layout("<4sLQL")
STORED, DEFLATED = 0, 8
UTF8_NAME = 0x0800
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
EXTRA64 = 1
FIRST_DAY = 0x21  # 1 January 1980

#: Bytes fetched at once when a directory, an index or neighbouring records are read.
WINDOW = 1 << 18


class PackageError(ValueError):
    """A package that does not follow the format, or needs more than ranges of it."""


def opened(uri: str):
    """(file system, path on it) of a URI; a plain path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Ranges:
    """Byte ranges of one file; what follows a small range is fetched with it and kept until the next fetch."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.uri, self.file = uri, system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.kept = 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise PackageError(f"{self.uri}: bytes {offset} to {offset + length} lie outside of its {self.size}")
        if not self.at <= offset <= offset + length <= self.at + len(self.kept):
            self.at, self.kept = offset, self.file.read_at(min(max(length, WINDOW), self.size - offset), offset)
        return self.kept[offset - self.at : offset - self.at + length]

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int
    """Where its local header stands."""


@dataclass(frozen=True)
class Directory:
    offset: int
    size: int
    entries: int
    shift: int
    """Bytes in front of the package that its own offsets do not count."""


def directory(source: Ranges) -> Directory:
    """Where the central directory stands, by the end record or the ZIP64 end record."""
    tail_at = max(0, source.size - END_FORM.size - FULL16)
    tail = source.read(tail_at, source.size - tail_at)
    found = tail.rfind(END)
    # A comment may hold the signature; the real record's comment ends with the file.
    while found >= 0 and (len(tail) - found < END_FORM.size or found + END_FORM.size + END_FORM.unpack(tail, found)[7] != len(tail)):
        found = tail.rfind(END, 0, found + len(END) - 1) if found else -1
    if found < 0:
        raise PackageError(f"{source.uri}: no end of a central directory")
    _, disk, first_disk, _, entries, size, offset, _ = END_FORM.unpack(tail, found)
    end = tail_at + found
    locator = end - LOCATOR64_FORM.size
    if locator >= 0 and source.read(locator, 4) == LOCATOR64:
        _, _, end64, disks = LOCATOR64_FORM.unpack(source.read(locator, LOCATOR64_FORM.size))
        if disks > 1:
            raise PackageError(f"{source.uri}: it is one of several volumes")
        if source.read(min(end64, source.size - 4), 4) != END64:  # bytes in front of the package
            end64 = locator - END64_FORM.size
        form = END64_FORM.unpack(source.read(end64, END64_FORM.size))
        if form[0] != END64:
            raise PackageError(f"{source.uri}: no ZIP64 end record where its locator points")
        entries, size, offset, end = *form[7:10], end64
    elif disk or first_disk:
        raise PackageError(f"{source.uri}: it is one of several volumes")
    return Directory(end - size, size, entries, end - size - offset)


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that are all ones taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA64:
            rest = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(rest) if value == FULL32 else value for value in values]
        at += 4 + length
    return values


def members(source: Ranges) -> Iterator[Member]:
    """The entries of the central directory, in its order."""
    found = directory(source)
    at, end = found.offset, found.offset + found.size
    for _ in range(found.entries):
        head = source.read(at, CENTRAL_FORM.size)
        form = CENTRAL_FORM.unpack(head)
        if form[0] != CENTRAL or at + CENTRAL_FORM.size > end:
            raise PackageError(f"{source.uri}: no central directory entry at {at}")
        flags, method, packed, size, header = form[3], form[4], form[8], form[9], form[16]
        name_n, extra_n, comment_n = form[10:13]
        rest = source.read(at + CENTRAL_FORM.size, name_n + extra_n)
        size, packed, header = _wide(rest[name_n:], [size, packed, header])
        name = rest[:name_n].decode("utf-8" if flags & UTF8_NAME else "cp437")
        yield Member(name, method, packed, size, header + found.shift)
        at += CENTRAL_FORM.size + name_n + extra_n + comment_n


def data_start(source: Ranges, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, which may differ from the directory in length."""
    form = LOCAL_FORM.unpack(source.read(member.header, LOCAL_FORM.size))
    if form[0] != LOCAL:
        raise PackageError(f"{source.uri}: no local header of {member.name!r} at {member.header}")
    return member.header + LOCAL_FORM.size + form[9] + form[10]


def inflated(pieces: Iterable[bytes], bits: int) -> Iterator[bytes]:
    """Bytes of one or more deflated streams in a row."""
    flow = zlib.decompressobj(bits)
    for piece in pieces:
        while piece:
            if out := flow.decompress(piece, WINDOW):
                yield out
            if flow.eof:
                piece, flow = flow.unused_data, zlib.decompressobj(bits)
            else:
                piece = flow.unconsumed_tail


def pieces(source: Ranges, member: Member) -> Iterator[bytes]:
    """A member's bytes in bounded pieces, unpacked where it is deflated."""
    start = data_start(source, member)
    raw = (source.read(at, min(WINDOW, start + member.packed - at)) for at in range(start, start + member.packed, WINDOW))
    if member.method == STORED:
        return raw
    if member.method == DEFLATED:
        return inflated(raw, -zlib.MAX_WBITS)
    raise PackageError(f"{source.uri}: {member.name!r} is packed by method {member.method}")


def lines(blocks: Iterable[bytes]) -> Iterator[bytes]:
    rest = b""
    for block in blocks:
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def package(contents: Iterable[tuple[str, bytes]], wide: bool = False) -> bytes:
    """A package of stored members. ZIP64 records are written where numbers need them, or always if ``wide``."""
    out, central, count = bytearray(), bytearray(), 0
    for name, data in contents:
        label, crc, header, n = name.encode(), zlib.crc32(data), len(out), len(data)
        big = wide or n >= FULL32 or header >= FULL32
        version, shown, shown_at = (45, FULL32, FULL32) if big else (20, n, header)
        extra = struct.pack("<2H2Q", EXTRA64, 16, n, n) if big else b""
        out += LOCAL_FORM.pack(LOCAL, version, UTF8_NAME, STORED, 0, FIRST_DAY, crc, shown, shown, len(label), len(extra))
        out += label + extra + data
        extra = struct.pack("<2H3Q", EXTRA64, 24, n, n, header) if big else b""
        central += CENTRAL_FORM.pack(
            CENTRAL, version, version, UTF8_NAME, STORED, 0, FIRST_DAY, crc, shown, shown, len(label), len(extra), 0, 0, 0, 0, shown_at
        )
        central += label + extra
        count += 1
    start, size = len(out), len(central)
    out += central
    if wide or count >= FULL16 or start >= FULL32 or size >= FULL32:
        end64 = len(out)
        out += END64_FORM.pack(END64, END64_FORM.size - 12, 45, 45, 0, 0, count, count, size, start)
        out += LOCATOR64_FORM.pack(LOCATOR64, 0, end64, 1)
    narrow = (FULL16, FULL16, FULL32, FULL32) if wide else (min(count, FULL16), min(count, FULL16), min(size, FULL32), min(start, FULL32))
    out += END_FORM.pack(END, 0, 0, *narrow, 0)
    return bytes(out)

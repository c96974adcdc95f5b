"""WARC records as bytes: writing, parsing, and finding them without an index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from cashtide.llm.zip_packages import WINDOW, PackageError, Ranges

# Names and texts of the WARC and HTTP formats.
VERSION = "WARC/1.1"
HTTP_RECORD = "application/http; msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Extension fields: the ids of the rows that records stand for.
PAGE_FIELD, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"

BREAK = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def payload_id(data: bytes) -> str:
    """The record id of the one response that carries a payload."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha256(data).hexdigest()).urn}>"


def one_line(value: str) -> str:
    """Control characters as percent codes, so that a value cannot end its header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, as a gzip member of its own; fields without a value are left out."""
    head = "".join(f"{name}: {one_line(value)}\r\n" for name, value in fields if value is not None)
    data = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + BREAK
    return gzip.compress(data, compresslevel=1, mtime=0)


def page_record(payload: bytes, own_id: str, date: str, uri: str | None, page: int | None, revisits: bool, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    text = lambda number: None if number is None else str(number)
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", own_id if revisits else payload_id(payload)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Profile", SAME_PAYLOAD if revisits else None),
        ("WARC-Refers-To", payload_id(payload) if revisits else None),
        ("Content-Type", HTTP_RECORD),
        (PAGE_FIELD, text(page)),
        (REFERS_FIELD, text(refers_to) if revisits else None),
    ]
    return record(fields, http if revisits else http + payload)


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def is_http(self) -> bool:
        return self.fields.get("content-type", "").startswith("application/http")

    def payload(self) -> bytes:
        return self.block.partition(BREAK)[2] if self.is_http else self.block

    def declared_bytes(self) -> int | None:
        """What the HTTP headers say of the payload's length."""
        stated = named(self.block.partition(BREAK)[0]).get("content-length", "") if self.is_http else ""
        return int(stated) if stated.isdigit() else None


def named(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line, a version or status, is passed over."""
    rows = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.decode("utf-8", "replace").strip().lower(): value.decode("utf-8", "replace").strip() for name, _, value in rows}


def parsed(data: bytes, where: str) -> Record:
    """The record that ``data`` holds, packed or not."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as error:
            raise PackageError(f"{where}: {error}") from error
    head, found, rest = data.partition(BREAK)
    fields = named(head)
    length = fields.get("content-length", "")
    if not head.startswith(b"WARC/") or not found or not length.isdigit() or int(length) > len(rest):
        raise PackageError(f"{where}: no whole WARC record")
    return Record(fields, rest[: int(length)])


def walk(source: Ranges, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of a stored archive without an index, read in bounded pieces."""
    at, end = start, start + size
    while at < end:
        packed = source.read(at, min(2, end - at)) == b"\x1f\x8b"
        length = (_packed_length if packed else _plain_length)(source, at, end)
        yield at - start, length
        at += length


def _packed_length(source: Ranges, at: int, end: int) -> int:
    flow, read = zlib.decompressobj(31), at
    while not flow.eof:
        if read >= end:
            raise PackageError(f"{source.uri}: a record at {at} does not end")
        piece = source.read(read, min(WINDOW, end - read))
        read += len(piece)
        while piece and not flow.eof:
            flow.decompress(piece, WINDOW)
            piece = flow.unconsumed_tail
    return read - len(flow.unused_data) - at


def _plain_length(source: Ranges, at: int, end: int) -> int:
    size = min(4096, end - at)
    while BREAK not in (head := source.read(at, size)):
        if size == end - at or size > 1 << 24:
            raise PackageError(f"{source.uri}: no WARC record at {at}")
        size = min(size * 4, end - at)
    head = head.partition(BREAK)[0]
    length = named(head).get("content-length", "")
    if not head.startswith(b"WARC/") or not length.isdigit():
        raise PackageError(f"{source.uri}: no WARC record at {at}")
    whole = len(head) + len(BREAK) + int(length) + len(BREAK)
    return min(whole, end - at)

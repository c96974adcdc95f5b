"""Web archives in ZIP packages: pages are written as WARC records and read back by ranges.

A package has one stored archive, its index and a description. Every record is a gzip member of its own, so an
index entry (offset and length) is all that reading a record takes. Tasks write packages under names nobody
else uses and return these; what counts is the stored table of returned names, so a task that is repeated or lost
leaves nothing but a file that no reader looks at.

Reading goes in two steps: packages become index entries (central directory, ZIP64 directory, local headers and
indexes are ranges too), entries are dealt out by package and by stretch of ``STRETCH`` bytes, and tasks read
the records of their stretches in order. A package of any size is thus shared among tasks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm import warc_records as warc
from cashtide.llm import zip_packages as zips
from cashtide.llm.tables import written
from cashtide.session import scratch_dir

#: Packed bytes after which a task closes a package.
PACKAGE_BYTES = 16 << 20
#: Bytes of an archive whose records one task reads together.
STRETCH = 4 << 20

#: The date of records, where no other is asked for: nothing reads the clock.
NO_DATE = "1970-01-01T00:00:00Z"

ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVES = re.compile(r"(^|/)archive/.*\.warc(\.gz)?$")
INDEXES = re.compile(r"(^|/)indexes/.*\.cdxj?(\.gz)?$")

MANIFEST = "package string, bytes long, records long"
ENTRIES = "package string, member string, start long, size long, offset long, length long"
RECORDS = (
    "package string, member string, offset long, record_type string, uri string, page_id long, refers_to long, "
    "payload_bytes long, payload_digest string, intact boolean, payload binary"
)


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): which rows become responses and which revisit them.

    Of rows with equal payloads of ``least`` bytes or more the one with the smallest page_id is the response (a missing id
    comes last); of several rows with that id any one, but only one. ``html`` NULL is an empty payload.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("_key", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    repeated = written(
        keyed.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first"))
        .where("_n > 1")
        .select("_key", "_first", F.lit(True).alias("_again")),
        "repeated-payloads",
    )
    marked = keyed.join(repeated, "_key", "left")
    may_lead = F.col("_again").isNotNull() & F.col("page_id").eqNullSafe(F.col("_first"))
    # Rows alike in id and payload are numbered once they are stored: the number must outlive a lost task.
    leaders = written(marked.where(may_lead).withColumn("_row", F.monotonically_increasing_id()), "first-of-payloads")
    chosen = leaders.groupBy(F.col("_key").alias("_of")).agg(F.min("_row").alias("_one"))
    leaders = leaders.join(chosen, F.col("_key") == F.col("_of")).withColumn("_revisits", F.col("_row") != F.col("_one"))
    others = marked.where(~may_lead).withColumn("_revisits", F.col("_again").isNotNull())
    wanted = [
        "page_id",
        "url",
        "html",
        F.when(F.col("_revisits"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("_revisits"), F.col("_first")).alias("refers_to"),
    ]
    return leaders.select(*wanted).unionByName(others.select(*wanted))


def sort_key(url: str) -> str:
    """The key indexes are ordered by: the host's labels from the last to the first, then the path, lower-cased."""
    host, slash, path = url.partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.lower()}".replace(" ", "%20")


class Packer:
    """Packages of bounded size, one after another, in a folder."""

    def __init__(self, folder: str, date: str, limit: int, wide: bool):
        self.folder, self.date, self.limit, self.wide = folder, date, limit, wide
        self.archive, self.index = bytearray(), []

    def add(self, page: int | None, url: str | None, html: str, kind: str, refers_to: int | None) -> None:
        payload, revisits = html.encode(), kind == "revisit"
        data = warc.page_record(payload, f"<{uuid.uuid4().urn}>", self.date, url, page, revisits, refers_to)
        shown = warc.one_line(url or "")
        about = {"url": shown, "digest": f"sha1:{warc.base32_sha1(payload)}", "filename": ARCHIVE.rpartition("/")[2]}
        about |= {"offset": str(len(self.archive)), "length": str(len(data)), "type": kind}
        stamp = re.sub(r"\D", "", self.date)
        self.index.append(f"{sort_key(shown)} {stamp} {json.dumps(about)}")
        self.archive += data

    def full(self) -> bool:
        return len(self.archive) >= self.limit

    def close(self) -> tuple[str, int, int]:
        """Write the package; its name, bytes and records."""
        name, records = f"{self.folder}/{uuid.uuid4().hex}.zip", len(self.index)
        about = json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]})
        contents = [(ARCHIVE, bytes(self.archive)), (INDEX, "".join(f"{x}\n" for x in sorted(self.index)).encode()), (ABOUT, about.encode())]
        data = zips.package(contents, self.wide)
        system, path = zips.opened(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(data)
        self.archive, self.index = bytearray(), []
        return name, len(data), records


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write(pages: DataFrame, folder: str, least: int = 0, date: str = NO_DATE, limit: int = PACKAGE_BYTES, wide: bool = False) -> DataFrame:
    """Write every row of ``pages`` as a record into packages below ``folder``; the stored list of these packages.

    Repeated rows have a record each. ``page_id``, ``url`` and ``html`` may be NULL and of any length (a
    record and its package are held in memory); other columns are ignored; an empty table writes no package. ``wide`` asks for ZIP64
    records even where numbers are small.
    """
    target = qualified(pages.sparkSession, folder)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done = Packer(target, date, limit, wide), []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                packer.add(*row)
                if packer.full():
                    done.append(packer.close())
        if packer.index:
            done.append(packer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["package", "bytes", "records"],
        )

    return written(with_types(pages, least).mapInArrow(pack, MANIFEST), "package-list")


def index_entries(source: zips.Ranges) -> Iterator[tuple[str, int, int, int, int]]:
    """(member, its start, its size, offset, length) of every record of a package, by its indexes.

    Archives that no index names are walked record by record.
    """
    archives, indexes = {}, []
    for member in zips.members(source):
        if ARCHIVES.search(member.name):
            if member.method != zips.STORED:
                raise zips.PackageError(f"{source.uri}: {member.name!r} is packed, so its records have no ranges")
            archives[member.name.rpartition("/")[2]] = member
        elif INDEXES.search(member.name):
            indexes.append(member)
    starts, listed = {name: zips.data_start(source, member) for name, member in archives.items()}, set()
    for index in indexes:
        blocks = zips.pieces(source, index)
        for line in zips.lines(zips.inflated(blocks, 31) if index.name.endswith(".gz") else blocks):
            _, brace, about = line.partition(b"{")
            if not brace:
                continue
            entry = json.loads(brace + about)
            name = entry["filename"].rpartition("/")[2]
            if name not in archives:
                raise zips.PackageError(f"{source.uri}: {index.name!r} names {name!r}, which is not there")
            listed.add(name)
            yield archives[name].name, starts[name], archives[name].size, int(entry["offset"]), int(entry["length"])
    for name, member in archives.items():
        if name not in listed:
            for offset, length in warc.walk(source, starts[name], member.size):
                yield member.name, starts[name], member.size, offset, length


def entries(packages: DataFrame) -> DataFrame:
    """Index entries of the packages named in the column ``package``; a package's directory and index are one task's."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("package").to_pylist():
                source, rows = zips.Ranges(uri), []
                for row in index_entries(source):
                    rows.append((uri, *row))
                    if len(rows) == 4096:
                        yield _batch(rows, ENTRY_TYPES)
                        rows = []
                yield _batch(rows, ENTRY_TYPES)
                source.close()

    return packages.where(F.col("package").isNotNull()).select("package").mapInArrow(look, ENTRIES)


_TEXT, _LONG = pa.string(), pa.int64()
ENTRY_TYPES = pa.schema([("package", _TEXT), ("member", _TEXT), ("start", _LONG), ("size", _LONG), ("offset", _LONG), ("length", _LONG)])
RECORD_TYPES = pa.schema(
    [("package", _TEXT), ("member", _TEXT), ("offset", _LONG), ("record_type", _TEXT), ("uri", _TEXT), ("page_id", _LONG)]
    + [("refers_to", _LONG), ("payload_bytes", _LONG), ("payload_digest", _TEXT), ("intact", pa.bool_()), ("payload", pa.binary())]
)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(columns, types)], schema=types)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def read_record(source: zips.Ranges, start: int, size: int, offset: int, length: int, payloads: bool) -> tuple:
    """What one range says: record_type, uri, page_id, refers_to, payload_bytes, payload_digest, intact, payload."""
    if offset < 0 or length < 0 or offset + length > size:
        raise zips.PackageError(f"{source.uri}: an index entry reaches from {offset} to {offset + length} of {size} bytes")
    found = warc.parsed(source.read(start + offset, length), f"{source.uri} at {offset}")
    stated = found.fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    about = [found.fields.get(name.lower()) for name in ("WARC-Type", "WARC-Target-URI")]
    about += [_number(found.fields.get(name.lower())) for name in (warc.PAGE_FIELD, warc.REFERS_FIELD)]
    if about[0] == "revisit":
        return *about, found.declared_bytes(), stated, None, None
    payload = found.payload()
    digest = warc.base32_sha1(payload)
    return *about, len(payload), digest, stated is None or stated == digest, payload if payloads else None


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages named in the column ``package``, without extracting anything.

    Per record: package, member, offset, record_type, uri, page_id, refers_to, payload_bytes, payload_digest (base32 SHA-1;
    of a revisit both are those of the payload it stands for), intact (whether the digest is the stated one; NULL for a
    revisit), payload (NULL for a revisit or without ``payloads``). Broken packages are errors that name
    the place. Repeated names are read once for each time; no names give no rows.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            rows, held = [], 0
            for uri, member, start, size, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                if source is None or source.uri != uri:
                    if source:
                        source.close()
                    source = zips.Ranges(uri)
                found = read_record(source, start, size, offset, length, payloads)
                rows.append((uri, member, offset, *found))
                held += len(found[-1] or b"")
                if held > STRETCH:
                    yield _batch(rows, RECORD_TYPES)
                    rows, held = [], 0
            yield _batch(rows, RECORD_TYPES)
        if source:
            source.close()

    names = ENTRY_TYPES.names
    dealt = (
        entries(packages)
        .withColumn("_stretch", F.floor(F.col("offset") / F.lit(STRETCH)))
        .repartition("package", "_stretch")
        .sortWithinPartitions("package", "start", "offset")
    )
    return dealt.select(*names).mapInArrow(fetch, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Packages of all pages in the shared folder, and the records read back from them."""
    folder = scratch_dir(pages.sparkSession, "packages")
    return read(write(pages, folder, least), payloads=False)

"""Sharding by histogram sort: shards of nearly equal bytes, found without sorting or sampling.

Rows are ordered by a hash of their text, then by a hash of their id, and rows alike in both by a hash of a number they
are stored with; so equal texts are neighbours, and a boundary can fall between any two rows.
The boundaries between shards are looked for by counting: one aggregation gives the exact bytes in each of
``PROBES`` equal ranges around every boundary not yet settled, the range that holds the wanted byte is
probed again, and so on until the bytes below a boundary are within the tolerance. Then every row knows
its shard, and rows are exchanged once, by shard and piece, to be numbered.

A round brings at most ``PROBES`` counts per boundary to the driver, whatever the input. A group of equal
texts, or of rows alike in id and text, stays together unless it is larger than ``GROUP_SHARE`` of a shard; then
the boundary falls inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.llm.tables import written

#: Bits settled by one round, and the counts per boundary that follow from it.
ROUND_BITS = 9
PROBES = 1 << ROUND_BITS
#: Bits of each part of the sort key.
KEY_BITS = 63

#: Tolerance in shares of a shard's fair bytes; the largest group of equal texts a boundary goes around.
TOLERANCE, GROUP_SHARE = 0.0005, 0.01

#: Rows that one task numbers, on average.
PIECE_ROWS, LEAST_PIECES = 50_000, 64


@dataclass
class Boundary:
    """A shard boundary being looked for: rows at or above (major, minor, tie) are above it."""

    target: float
    below: int = 0
    major: int = 0
    minor: int = 0
    tie: int = 0
    settled: bool = False

    def passed(self) -> Column:
        """Whether a row is at or above it."""
        major, minor, tie = F.col("major"), F.col("minor"), F.col("tie")
        beyond = (major > self.major) | (major == self.major) & (minor > self.minor)
        return beyond | (major == self.major) & (minor == self.minor) & (tie >= self.tie)


def sort_keys(text: Column, doc_id: Column) -> dict[str, Column]:
    """The parts of the key, 63 bits each, so that they order alike signed and unsigned.

    ``tie`` hashes where a row stands when it is first written; rows must be stored with it before they are compared.
    """
    parts = {
        "major": F.xxhash64(F.coalesce(text, F.lit(""))),
        "minor": F.xxhash64(doc_id, F.lit("row")),
        "tie": F.xxhash64(F.monotonically_increasing_id()),
    }
    return {name: F.shiftrightunsigned(part, 1) for name, part in parts.items()}


def keyed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, text_crc32, major, minor, tie; stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[part.alias(name) for name, part in sort_keys(F.col("text"), F.col("doc_id")).items()],
    )
    return written(rows, "shard-keys")


def find_boundaries(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Boundary]:
    """The ``shards - 1`` boundaries of ``rows`` (size, major, minor, tie)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = total / shards
    found = [Boundary(fair * i) for i in range(1, shards)]
    close, group = tolerance * fair, GROUP_SHARE * fair
    _refine(rows, found, "major", close, group)
    # What is open now lies inside a large group of equal texts.
    for major in sorted({b.major for b in found if not b.settled}):
        inside = [b for b in found if not b.settled and b.major == major]
        _refine(rows.where(F.col("major") == major), inside, "minor", close, group)
    # And now inside a large group of rows that are alike.
    for major, minor in sorted({(b.major, b.minor) for b in found if not b.settled}):
        inside = [b for b in found if not b.settled and (b.major, b.minor) == (major, minor)]
        _refine(rows.where((F.col("major") == major) & (F.col("minor") == minor)), inside, "tie", close, float("inf"))
    return found


def _refine(rows: DataFrame, found: list[Boundary], part: str, tolerance: float, group: float) -> None:
    """Narrow one part of the key of all open boundaries, ``ROUND_BITS`` bits a round."""
    start = {id(b): 0 for b in found}
    known = 0
    while known < KEY_BITS and (open_now := [b for b in found if not b.settled]):
        step = min(ROUND_BITS, KEY_BITS - known)
        rest = KEY_BITS - known - step
        ranges = sorted({start[id(b)] for b in open_now})
        bins = (
            rows.where(F.shiftrightunsigned(part, rest + step).isin(ranges) if known else F.lit(True))
            .groupBy(F.shiftrightunsigned(part, rest).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        by_range: dict[int, list] = {}
        for row in sorted(bins, key=lambda r: r.bin):
            by_range.setdefault(row.bin >> step, []).append(row)
        for b in open_now:
            below = b.below
            for row in by_range.get(start[id(b)], []):
                if below + row.bytes < b.target:
                    below += row.bytes
                    continue
                low, high = b.target - below, below + row.bytes - b.target
                start[id(b)], b.below = row.bin, below
                whole = rest == 0 and row.bytes <= group or row.n == 1
                if min(low, high) <= tolerance or whole:
                    after = high < low
                    b.settled, b.below = True, below + (row.bytes if after else 0)
                    setattr(b, part, (row.bin + after) << rest)
                break
        known += step
    for b in found:
        if not b.settled:
            setattr(b, part, start[id(b)])


def place(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Stored ``rows`` (size, major, minor, tie and any others) with ``shard`` and ``slot``.

    A shard's slots run from 0 without gaps, in the order of pieces (a hash of the row) and of the key inside a piece.
    """
    shard = sum((F.when(b.passed(), 1).otherwise(0) for b in find_boundaries(rows, shards, tolerance)), F.lit(0)).cast("int")
    pieces = max(LEAST_PIECES, -(-rows.count() // (shards * PIECE_ROWS)))
    piece = F.pmod(F.xxhash64("minor", "major", "tie"), F.lit(pieces)).cast("int")
    first = (
        rows.groupBy(shard.alias("shard"), piece.alias("_piece"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_first", F.sum("n").over(Window.partitionBy("shard").orderBy("_piece")) - F.col("n"))
        .select("shard", "_piece", "_first")
    )
    numbered = rows.withColumns({"shard": shard, "_piece": piece}).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("major", "minor", "tie"))
    )
    return (
        numbered.join(first, ["shard", "_piece"])
        .withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long"))
        .drop("_first", "_rank", "_piece")
    )


def assign(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: every shard holds as many bytes as the next, a byte being counted for each row
    besides its text; ``grown_shard`` is null. A null text has the size and checksum of an empty one. Repeated rows
    have a slot each and may lie in several shards. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    return place(keyed(docs), shards, tolerance).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write(docs: DataFrame, path: str, shards: int = 8, tolerance: float = TOLERANCE) -> None:
    """Write whole rows below ``path``, a folder ``shard=<n>`` each, with their ``slot``; rows are stored with their keys
    and then move once."""
    clash = [c for c in ("size", "major", "minor", "tie", "shard", "slot", "_piece", "_rank", "_first") if c in docs.columns]
    if clash:
        raise ValueError(f"columns {clash} are needed for sharding; rename them first")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long")
    rows = written(docs.withColumns({"size": size, **sort_keys(F.col("text"), F.col("doc_id"))}), "shard-rows")
    place(rows, shards, tolerance).drop("size", "major", "minor", "tie").write.partitionBy("shard").parquet(path)

"""Vector code compression: product codes learned and assigned in exact integer arithmetic.

Components become integers, vectors are cut into equal parts, and every part position has a codebook that
starts from the vectors of the smallest ids and is refined by a few rounds of nearest entry and floored mean.

Nearest entries come from matrix products. ``|x - c|^2 = |x|^2 - 2 x.c + |c|^2`` needs one product of a part's
vectors with its codebook, and float64 BLAS is exact only below 2^53. So integers are broken into signed limbs
narrow enough for a sum of products to stay below that; products of limbs are recombined in int64. Distances are
exact integers, so the first least one is the same on every machine, whatever order BLAS adds in.

Tasks hold a codebook (parts x entries x width integers) and one slice of vectors; per round each sends one row of
sums for every component of the codebook at most. Nothing else reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtide.llm.tables import written

#: Components are counted in steps of 1 / SCALE.
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2

#: Integers that a float64 holds exactly, and bits of the sums that int64 holds.
EXACT_BITS, SUM_BITS = 53, 63

#: Vectors whose distances are held at a time.
SLICE = 1024

SUMS = "part int, entry int, position int, total long, n long"


def limb_bits(width: int) -> int:
    """The widest signed limb such that ``width`` products of two limbs add up to less than 2^53."""
    # A limb of b bits is at most 2^(b-1) in size, so a product is at most 2^(2b-2).
    return (EXACT_BITS - 1 - max(width - 1, 0).bit_length()) // 2 + 1


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays, lowest first, with ``values = sum(limb[i] * 2^(bits * i))`` and limbs in [-2^(bits-1), 2^(bits-1))."""
    found, half, rest = [], 1 << (bits - 1), values.astype(np.int64)
    while not found or rest.any():
        low = ((rest + half) & ((1 << bits) - 1)) - half
        found.append(low.astype(np.float64))
        rest = (rest - low) >> bits
    return found


def exact_dot(left: np.ndarray, right: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``left @ right`` of integers, exact in int64 where the result fits."""
    bits = limb_bits(left.shape[-1]) if bits is None else bits
    total = np.zeros((*left.shape[:-1], right.shape[-1]), np.int64)
    high = limbs(right, bits)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(high):
            total += (a @ b).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``parts`` (part, row, position) and ``books`` (part, entry, position): index of the first nearest entry and
    its squared distance, both (part, row)."""
    distance = (
        (parts * parts).sum(2)[:, :, None]
        - 2 * exact_dot(parts, books.transpose(0, 2, 1))
        + (books * books).sum(2)[:, None, :]
    )
    chosen = distance.argmin(2)
    return chosen, np.take_along_axis(distance, chosen[:, :, None], 2)[:, :, 0]


def integers(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """``floor(scale * x)``; components so large that a squared distance would not fit int64 are an error."""
    scaled = np.floor(values.astype(np.float64) * scale)
    most = 1 << ((SUM_BITS - max(width, 1).bit_length()) // 2 - 1)
    if scaled.size and np.abs(scaled).max() >= most:
        raise OverflowError(f"components of {most / scale:g} and more have no exact 64-bit distances")
    return scaled.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], dimension: int, parts: int, scale: int) -> Iterator[tuple]:
    """(rows, their parts as (part, row, position) integers) in bounded slices."""
    width = dimension // parts
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            piece = batch.slice(start, SLICE)
            flat = piece.column("vector").flatten().to_numpy(zero_copy_only=False)
            whole = integers(flat.reshape(piece.num_rows, dimension), scale, width)
            yield piece, np.ascontiguousarray(whole.reshape(-1, parts, width).transpose(1, 0, 2))


@dataclass(frozen=True)
class Codebooks:
    """Entries as (part, entry, position) integers, and what vectors they are for."""

    entries: np.ndarray
    dimension: int
    scale: int = SCALE

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is there and has only finite components."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & finite)


def _first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the vectors of the ``entries`` smallest ids that have the dimension of the smallest one."""
    in_order = [F.col("vec_id").asc_nulls_last()]
    one = rows.select("vec_id", F.size("vector").alias("n")).orderBy(*in_order, "n").limit(1).collect()
    if not one:
        return None
    dimension = one[0].n
    if not dimension or dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    fit = rows.where(F.size("vector") == dimension)
    ids = [row.vec_id for row in fit.select("vec_id").distinct().orderBy(*in_order).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    first = (
        fit.where(named | F.col("vec_id").isNull() if None in ids else named)
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
        .orderBy(*in_order)
        .collect()
    )
    whole = integers(np.array([row.vector for row in first], np.float64), scale, dimension // parts)
    cut = whole.reshape(len(first), parts, dimension // parts)
    return Codebooks(np.ascontiguousarray(cut.transpose(1, 0, 2)), dimension, scale)


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Sums and counts of the parts nearest to every entry: a row for each component of the codebooks and task."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(books.entries.shape, np.int64)
        count = np.zeros(books.entries.shape[:2], np.int64)
        for _, cut in _slices(batches, books.dimension, books.parts, books.scale):
            chosen, _ = nearest(cut, books.entries)
            for part in range(books.parts):
                np.add.at(total[part], chosen[part], cut[part])
                count[part] += np.bincount(chosen[part], minlength=count.shape[1])
        part, entry = np.nonzero(count)
        width = total.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width), pa.int32()),
                pa.array(np.repeat(entry, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
                pa.array(total[part, entry].ravel(), pa.int64()),
                pa.array(np.repeat(count[part, entry], width), pa.int64()),
            ],
            names=["part", "entry", "position", "total", "n"],
        )

    fit = rows.where(F.size("vector") == books.dimension).select("vector")
    return fit.mapInArrow(add_up, SUMS).groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all rows of ``vectors``; None when no row has a usable vector.

    A book starts from the vectors of the ``entries`` smallest ids (of repeated ids the least vector; a missing
    id comes last), fewer where there are fewer. Every round replaces an entry by the floored mean of the parts
    nearest to it; an entry that no part is nearest to stays.
    """
    rows = usable(vectors, vector)
    books = _first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        moved = books.entries.copy()
        for row in _sums(rows, books).collect():  # parts x entries x width rows at most
            moved[row.part, row.entry, row.position] = int(row.total) // row.n
        books = Codebooks(moved, books.dimension, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """vec_id, label, code, error of every usable row. Code and error are NULL for a vector of another length
    than the books are for."""
    rows = usable(vectors, vector)
    kinds = T.StructType([rows.schema["vec_id"], rows.schema["label"]])
    out = T.StructType([*kinds.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, cut in _slices(batches, books.dimension, books.parts, books.scale):
            chosen, distance = nearest(cut, books.entries)
            text = [row.tobytes().hex() for row in chosen.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array(text, pa.string()), pa.array(distance.sum(0), pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    fit = F.size("vector") == books.dimension
    others = rows.where(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return rows.where(fit).mapInArrow(assign, out).unionByName(others)


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable row: vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256.

    Rows whose vector is NULL or holds NULL, NaN or infinite components are left out. ``vec_id`` may repeat or be
    missing; every row keeps its place. ``label_error`` is the sum over equal labels, missing labels together
    (all rows, where there is no such column); other columns are ignored. An empty table gives no rows. The
    dimension is that of the smallest id's vector: rows of another length have no code and no error. A dimension
    that ``parts`` does not divide and components too large for exact 64-bit distances are errors.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    books = fit(vectors, vector, parts, entries, rounds, scale)
    if books is None:
        rows = usable(vectors, vector).select("vec_id", "label").limit(0)
        nothing = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    codes = written(encode(vectors, books, vector), "vector-codes")
    # Stored, so that Spark knows its size: a small one is broadcast, and a hot label costs nothing either way.
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (
        codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("codebooks_sha256", F.lit(books.sha256()))
    )

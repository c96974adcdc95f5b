"""Exact deduplication over an extendible-hash index, in DataFrame operations only.

Directory. It starts with one slot and doubles; at each doubling the buckets over ``capacity`` split on one
more leading bit of the hash. Bit counts for all doublings come from one histogram of the hashes, so it is made
before any text moves. It is a small table in the shared folder, one row per slot; several slots may name one
bucket. Copies of one text are one hash, so a text that makes up a third of the corpus overfills nothing.

Owner tasks. Every row goes by its hash to a slot, by the slot to a bucket, and with its text to the one task
that owns the bucket. There rows of equal hash are a chain; the owner compares their bytes, and each distinct text
is one entry of its chain. Two texts with one hash stay two entries. Copies of a text that comes more
often than ``FOLDED`` times are folded where they are read, so each reading task sends it once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.llm.tables import split_by_ids, written

#: Hashes a bucket may hold before it splits.
CAPACITY = 4096

#: Rows of one hash up to which each is sent to the owner by itself.
FOLDED = 16


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def slot_of(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of the hash."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The stored directory (slot, bucket, local_depth, n_hashes), and the global depth, its number of bits.

    ``hashes`` has one row per ``key``. ``bucket`` is the lowest slot that names the bucket. The depth at which
    even the fullest bucket fits is looked for by doubling on from the depth at which buckets fit on average.
    """
    total = hashes.count()
    depth = max(1, math.ceil(math.log2(max(total, 1) / capacity)) + 1)
    counts = None
    while counts is None or depth < 63 and counts.where(F.col("n") > capacity).limit(1).count():
        depth += 0 if counts is None else 1
        counts = hashes.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)")
    )
    sizes = levels.groupBy("local_depth", "prefix").agg(F.sum("n").alias("n_hashes"))
    # A bucket is the shallowest prefix that fits; what lies below it is never split.
    fitting = (
        levels.select("slot", "local_depth", "prefix")
        .join(sizes, ["local_depth", "prefix"])
        .where((F.col("n_hashes") <= capacity) | (F.col("local_depth") == depth))
    )
    slots = fitting.groupBy("slot").agg(F.min(F.struct("local_depth", "prefix", "n_hashes")).alias("b"))
    named = slots.select(
        "slot",
        F.expr(f"shiftleft(b.prefix, {depth} - b.local_depth)").alias("bucket"),
        F.col("b.local_depth").alias("local_depth"),
        F.col("b.n_hashes").alias("n_hashes"),
    )
    return written(named, "dedup-directory"), depth


def addressed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the bucket of their ``key``, and its local_depth, as the directory says.

    A slot that the directory has not seen names a bucket of its own, so no row is lost.
    """
    slot = slot_of(F.col("key"), depth)
    found = rows.withColumn("slot", slot).join(slots.select("slot", "bucket", "local_depth"), "slot", "left")
    return found.withColumns(
        {"bucket": F.coalesce("bucket", "slot"), "local_depth": F.coalesce("local_depth", F.lit(depth))}
    ).drop("slot")


def entries(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """One row per distinct text: bucket, local_depth, key, text, row, n_rows; and the directory with its depth.

    ``rows`` has key, text and row; the largest row of a text stays. The owner of a bucket sorts what it is sent
    by hash and bytes, so the entries of a chain are neighbours, and compares neighbours.
    """
    rows = rows.withColumn("n_rows", F.lit(1).cast("long"))
    hashes = written(rows.groupBy("key").agg(F.sum("n_rows").alias("n_rows")), "dedup-hashes")
    slots, depth = directory(hashes, capacity)
    joined = [F.max("row").alias("row"), F.sum("n_rows").alias("n_rows")]
    often, seldom = split_by_ids(rows, "key", hashes.where(F.col("n_rows") > FOLDED).select("key"))
    folded = often.withColumn("reader", F.spark_partition_id()).groupBy("reader", "key", "text").agg(*joined)
    sent = addressed(seldom.unionByName(folded.drop("reader")), slots, depth).repartition("bucket")
    return sent.groupBy("bucket", "local_depth", "key", "text").agg(*joined), slots, depth


def _index(docs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    text = F.coalesce(F.col("text"), F.lit(""))
    found, slots, depth = entries(
        docs.select(key_of(text).alias("key"), text.alias("text"), F.col("doc_id").alias("row")), capacity
    )
    named = found.withColumns({"text_sha256": F.sha2(F.col("text"), 256), "keep_id": F.col("row"), "group_size": F.col("n_rows")})
    chained = named.withColumn(
        "chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")) - 1
    )
    return chained.select("bucket", "local_depth", "key", "chain", "text_sha256", "keep_id", "group_size"), slots, depth


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index: bucket, local_depth, key, chain, text_sha256, keep_id, group_size.

    ``chain`` numbers the entries of equal hash from 0. A bucket is in one partition.
    """
    return _index(docs, capacity)[0]


def classes(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null texts count as empty and so equal the empty text. Of equal texts the row with the largest doc_id is
    kept; a null doc_id is smaller than any other. If the row to keep is itself repeated, all its
    repetitions say kept; ``survivors`` returns it once. Other columns of ``docs`` are ignored.
    """
    index, slots, depth = _index(docs, capacity)
    index = written(index.sortWithinPartitions("bucket", "key", "chain"), "dedup-index").drop("local_depth")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", key_of(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
    return addressed(rows, slots, depth).join(index, ["bucket", "key", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
        "bucket",
        "chain",
    )


def survivors(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The kept row of every group of equal texts, once, with all its columns.

    The owner of a text keeps the row with the largest doc_id while it compares bytes, so rows are exchanged
    once. Rows that tie on doc_id are ordered by their other columns.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    payload = F.struct("doc_id", *(F.col(f"`{c}`") for c in others), F.col("text").isNull().alias("_null"))
    kept = entries(docs.select(key_of(text).alias("key"), text.alias("text"), payload.alias("row")), capacity)[0]
    shown = {"doc_id": F.col("row.doc_id"), "text": F.when(~F.col("row._null"), F.col("text"))}
    return kept.select(*((shown[c] if c in shown else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))

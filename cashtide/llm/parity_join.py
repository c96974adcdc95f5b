"""N-gram Jaccard join by parity sketches: every pair of texts whose shingle sets are alike, and their classes.

A document's shingles are XOR-hashed into a bit sketch: each flips one bit, so two sketches differ in at most
as many bits as the sets have shingles they do not share. At a Jaccard of ``a / 100`` or more, sets of sizes n
and m differ in at most ``(n + m) * (100 - a) / (100 + a)`` shingles. Sizes fall into bands; the sketch of a band
has one block of 64 bits more than its largest pair may differ in, so of two alike sets at least one
block holds the same shingles (pigeonhole), and equal blocks are joined. A block's key is the sum of its shingles'
whole hashes, so blocks of few shingles are told apart too. A document just above a band's upper end also takes
part in that band, since it may be like a document below. No pair is lost.

Empty blocks are equal in documents that have nothing in common. Bands below ``MANY_BLOCKS`` blocks therefore have
``SPARE`` more, so that at least ``SPARE + 1`` blocks are equal: one that is not empty, or so many empty
ones, and a document's empty blocks are keyed by groups of ``SPARE + 1`` only. Where alike sets may not differ at all, the
whole set is the block.

Buckets of equal blocks may hold thousands of near copies, so their pairs are never listed. In each bucket
the document that shares most with others is the hub; members are held against it, and what is alike
becomes one class. In buckets that still hold several classes, members of different classes are held
against each other, in tiles of bounded size that are dealt out in pairs, so a hot bucket is the work of many tasks.
A pair is first held against the bound by short sketches of the whole sets (again parity,
so a pair beyond the bound is surely not alike); the few that remain are verified on the sets of words.
Pairs inside one class need no check, as only classes are asked for.

One exception to pigeonhole: a block with two bits or fewer says little, and at a Jaccard of 0.8 a quarter of
the blocks are so. In bands of ``MANY_BLOCKS`` blocks or more they are left out. A pair at the threshold has
each block equal with a chance of over a third, so the chance that it shares none of the others is below 1e-9.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.llm.components import components
from cashtide.llm.tables import split_by_ids, written
from cashtide.llm.wordhash import Words, scramble, shingle_hashes, shingle_set

#: Words end at ASCII white space.
WORDS = Words(b" \t\n\x0b\x0c\r")

#: Blocks of ``WEAK_BITS`` bits or fewer are left out in bands of so many blocks.
MANY_BLOCKS, WEAK_BITS = 64, 2

#: Blocks of a band for each word of the short sketch, and words of a short sketch at least.
BLOCKS_A_WORD, LEAST_WORDS = 4, 2

#: Blocks that smaller bands have beyond those that pigeonhole asks for.
SPARE = 3

#: Members, and bytes of their short sketches, about, that a tile of a bucket may hold.
TILE_ROWS, TILE_BYTES = 4096, 1 << 24

#: Members of a tile held against members of another at once, at most, and bytes of the array this makes.
TILE, ARRAY_BYTES = 512, 1 << 25

#: Each band's sizes reach to half as much again as those of the band before.
BAND_RATIO = 1.5


def _band_ends() -> tuple[int, ...]:
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
    return tuple(ends)


#: The largest size of each band. A plain value, so that it travels with the functions that tasks run.
BAND_ENDS = _band_ends()


def bands_of(size: int, percent: int) -> list[int]:
    """The bands a set takes part in: its own, and those below whose largest set it may be like."""
    bands = [bisect_left(BAND_ENDS, size)]
    while bands[-1] and size * percent <= 100 * BAND_ENDS[bands[-1] - 1]:
        bands.append(bands[-1] - 1)
    return bands


def blocks_of(band: int, percent: int) -> int:
    """One more than the shingles in which two alike sets of this band may differ."""
    end = BAND_ENDS[band]
    return differing(end, end * 100 // percent, percent) + 1


def differing(n: int, m: int, percent: int) -> int:
    """The most shingles that alike sets of these sizes do not share."""
    return (n + m) * (100 - percent) // (100 + percent)


def sketch(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The parity sketch: ``blocks`` words of 64 bits."""
    block = (hashes >> np.uint64(6)) % np.uint64(blocks)
    flips = np.bincount((block * np.uint64(64) + (hashes & np.uint64(63))).astype(np.int64), minlength=64 * blocks) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def bucket_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """A 64-bit key per band and block, or group of empty blocks, that the document takes part with."""
    keys, whole = [], scramble(hashes)
    for b in bands_of(len(hashes), percent):
        least = blocks_of(b, percent)
        n = least + SPARE if 1 < least < MANY_BLOCKS else least
        block = ((hashes >> np.uint64(6)) % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, block, whole)
        name = np.arange(n, dtype=np.uint64) + np.uint64(b << 40)
        own = scramble(sums + scramble(name))
        if n >= MANY_BLOCKS:
            keys.append(own[np.bitwise_count(sketch(hashes, n)) > WEAK_BITS])
            continue
        held = np.bincount(block, minlength=n) > 0
        keys.append(own[held])
        empty = list(combinations(np.flatnonzero(~held).tolist(), SPARE + 1))
        if empty:
            group = np.zeros(len(empty), np.uint64)
            for column in np.array(empty).T:
                group = scramble(group + scramble(name[column]))
            keys.append(group)
    return np.concatenate(keys).view(np.int64)


def short_sketches(hashes: np.ndarray, percent: int) -> list[dict]:
    """A parity sketch of the whole set for each of its bands, long enough to tell the bound."""
    words = {b: max(LEAST_WORDS, -(-blocks_of(b, percent) // BLOCKS_A_WORD)) for b in bands_of(len(hashes), percent)}
    return [{"band": b, "words": sketch(scramble(hashes), n).view(np.int64).tolist()} for b, n in words.items()]


def folded_digest(text: Column) -> Column:
    """A digest of the words of a text, by which texts of equal words are one."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.sha2(F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")), 256))


def distinct_shingles(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(WORDS.hashes(text), k))


SHORT = "array<struct<band:int,words:array<bigint>>>"


def sketched(docs: DataFrame, k: int, percent: int, fold: bool) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) as digest, node, n (shingles), keys, short; stored.

    With ``fold``, documents of equal words are one node, the smallest doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("band", pa.int32()), ("words", pa.list_(pa.int64()))]))
        for batch in batches:
            sizes, keys, short = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = distinct_shingles(text.as_py() or b"", k)
                sizes.append(len(hashes))
                keys.append(bucket_keys(hashes, percent) if len(hashes) else np.empty(0, np.int64))
                short.append(short_sketches(hashes, percent) if len(hashes) else [])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            made = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(short, arrow)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("node"), *made], ["digest", "node", "n", "keys", "short"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select(folded_digest(F.coalesce("text", F.lit(""))).alias("digest"), F.col("doc_id").alias("node"), "text")
    rows = named.mapInArrow(run, f"digest binary, node {kind}, n bigint, keys array<bigint>, short {SHORT}")
    if fold:
        firsts = (F.first(c).alias(c) for c in ("n", "keys", "short"))
        rows = rows.groupBy("digest").agg(F.min("node").alias("node"), *firsts)
    return written(rows, "parity-nodes")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """Members (key, node, n) of all buckets that hold more than one, with the number they hold, stored."""
    rows = nodes.where("node IS NOT NULL").select("node", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    counted = rows.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")).cast("int"))
    return written(counted.where("members > 1"), "parity-buckets")


def alike_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def bound_of(n: Column, m: Column, percent: int) -> Column:
    return F.floor((n + m) * F.lit(100 - percent) / F.lit(100 + percent))


def hubs_of(buckets: DataFrame) -> DataFrame:
    """The hub (key, hub: weight, node, n) of each bucket."""
    weight = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    return buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))


def hub_pairs(buckets: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Each member with the hub of its bucket: a, b, with a < b, once however many buckets they share."""
    met = buckets.join(hubs, "key").where(
        (F.col("node") != F.col("hub.node")) & alike_sizes(F.col("n"), F.col("hub.n"), percent)
    )
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose short sketches do not show that they are beyond the bound."""
    short = nodes.select("node", "n", "short")
    left = short.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("short").alias("short_a"))
    right = short.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("short").alias("short_b"))
    # The lowest band of either set that both take part in.
    band = F.greatest(F.array_min("short_a.band"), F.array_min("short_b.band"))
    words = lambda s: F.filter(s, lambda x: x["band"] == band)[0]["words"]
    flips = F.zip_with(words("short_a"), words("short_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(flips, F.lit(0), lambda total, x: total + x)
    met = pairs.join(left, "a").join(right, "b")
    return met.where(apart <= bound_of(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose texts are alike, by the sets of their words; ``docs`` are (node, text), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, set()
        for batch in batches:
            alike = []
            for left, right in zip(batch.column("of_a").cast(pa.binary()), batch.column("of_b").cast(pa.binary()), strict=True):
                text = left.as_py()
                if text != last[0]:
                    last = text, shingle_set(WORDS.split(text), k)
                one, other = last[1], shingle_set(WORDS.split(right.as_py()), k)
                both = len(one & other)
                alike.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    pairs = written(pairs, "parity-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text for an id, so that repeated rows do not multiply a pair.
    texts = split_by_ids(docs, "node", wanted)[0].join(wanted, "node").groupBy("node").agg(F.min("text").alias("text"))
    texts = written(texts, "parity-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("of_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("of_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, f"a {kind}, b {kind}")


def row_bytes(n: Column, percent: int) -> Column:
    """At least the bytes of the short sketches of a set of ``n`` shingles."""
    words = n * F.lit(BAND_RATIO * (100 - percent) / percent / BLOCKS_A_WORD) + F.lit(LEAST_WORDS + 1)
    # Of each further band a third fewer.
    return words * F.lit(8 / (1 - 1 / BAND_RATIO))


def tiled(members: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, n, component) of buckets of several classes as key, node, component, tile, left, right.

    A class that fills more than a tile has tiles of its own, the others of its bucket share theirs. ``left`` and
    ``right`` name a pair of tiles to be held against each other; a row stands once for every pair its
    tile is in. Two tiles of one class are no such pair, so a large class costs its size, not its square.
    """

    def parts(rows: Column, size: Column) -> Column:
        return F.greatest(F.ceil(rows / F.lit(TILE_ROWS)), F.ceil(size / F.lit(TILE_BYTES)), F.lit(1)).cast("int")

    of_class = members.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(F.col("n"), percent)).alias("size")
    )
    large = parts(F.col("rows"), F.col("size")) > 1
    of_bucket = (
        of_class.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("classes"),
            parts(F.sum(F.when(~large, F.col("rows")).otherwise(0)), F.sum(F.when(~large, F.col("size")).otherwise(0.0))).alias("shared"),
            F.array_sort(
                F.collect_list(F.when(large, F.struct("component", parts(F.col("rows"), F.col("size")).alias("parts"))))
            ).alias("large"),
        )
        .where("classes > 1")
        .drop("classes")
    )
    rows = members.select("key", "node", "component").join(of_bucket, "key")
    # Group 0 is shared; the others are the large classes in order. A tile is a group and a part of it.
    rows = rows.withColumn("group", F.array_position(F.transform("large", lambda c: c["component"]), F.col("component")).cast("long"))
    sizes = F.concat(F.array("shared"), F.transform("large", lambda c: c["parts"]))
    tile = lambda group, part: F.shiftleft(group.cast("long"), 32) + part.cast("long")
    rows = rows.withColumn("sizes", sizes).withColumn(
        "tile", tile(F.col("group"), F.pmod(F.xxhash64("node"), F.get("sizes", F.col("group").cast("int"))))
    )
    tiles = F.flatten(
        F.transform("sizes", lambda n, g: F.transform(F.sequence(F.lit(0), n - 1), lambda part: tile(g, part)))
    )
    met = F.filter(tiles, lambda t: (F.col("group") == 0) | (F.shiftright(t, 32) != F.col("group")))
    return rows.select("key", "node", "component", "tile", F.explode(met).alias("_met")).select(
        "key", "node", "component", "tile", F.least("tile", "_met").alias("left"), F.greatest("tile", "_met").alias("right")
    )


def open_pairs(buckets: DataFrame, hubs: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Near pairs (a, b) of different classes that share a bucket, apart from those with its hub.

    Rows of the buckets that still hold several classes are dealt out by pairs of tiles and held against each other as
    whole arrays; only pairs within the bound leave the task.
    """
    members = buckets.where("members > 2").join(hubs.select("key", F.col("hub.node").alias("_hub")), "key")
    members = members.where("node <> _hub").drop("_hub")
    of_class = members.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = tiled(of_class.select("key", "node", "n", "component"), percent)
    deal = ["key", "left", "right"]
    dealt = rows.join(nodes.select("node", "n", "short"), "node").repartition(*deal).sortWithinPartitions(*deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            edges = _edges(table)
            if not len(edges):
                rest = table
                continue
            rest = table.slice(int(edges[-1]))
            yield _near_in_tiles(table.slice(0, int(edges[-1])), percent)
        if rest is not None:
            yield _near_in_tiles(rest, percent)

    kind = nodes.schema["node"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _edges(rows: pa.RecordBatch) -> np.ndarray:
    """Where another pair of tiles begins."""
    named = [rows.column(c).to_numpy() for c in ("key", "left", "right")]
    return np.flatnonzero(np.any([x[1:] != x[:-1] for x in named], axis=0)) + 1


class _Shorts:
    """The short sketches of a batch, read in place."""

    def __init__(self, column: pa.ListArray):
        sketches = column.values
        self._of_row, self._bands = column.offsets.to_numpy(), sketches.field("band").to_numpy()
        words = sketches.field("words")
        self._of_words, self._words = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The sketches of these rows in the lowest band that all take part in."""
        first, end = self._of_row[rows], self._of_row[rows + 1]
        band = max(self._bands[a:b].min() for a, b in zip(first, end, strict=True))
        at = [a + int(np.flatnonzero(self._bands[a:b] == band)[0]) for a, b in zip(first, end, strict=True)]
        return np.stack([self._words[self._of_words[i] : self._of_words[i + 1]] for i in at])


def _near_in_tiles(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Near pairs among rows that are in the order of their pairs of tiles."""
    n, tile = rows.column("n").to_numpy(), rows.column("tile").to_numpy()
    first, second = rows.column("left").to_numpy(), rows.column("right").to_numpy()
    classes = rows.column("component").to_numpy(zero_copy_only=False)
    short = _Shorts(rows.column("short"))
    begin = np.r_[0, _edges(rows)]
    left, right = [], []
    for at, end in zip(begin, [*begin[1:], rows.num_rows], strict=True):
        if end - at < 2:
            continue
        every = np.arange(at, end)
        words = short.of(every)
        one = every[tile[at:end] == first[at]]
        other = every[tile[at:end] == second[at]]
        step = max(1, min(TILE, int((ARRAY_BYTES / words[0].nbytes) ** 0.5)))
        for i in range(0, len(one), step):
            a = one[i : i + step]
            for j in range(i if first[at] == second[at] else 0, len(other), step):
                b = other[j : j + step]
                open_ = classes[a][:, None] != classes[b][None]
                both = n[a][:, None] + n[b][None]
                open_ &= np.minimum(n[a][:, None], n[b][None]) * 100 >= np.maximum(n[a][:, None], n[b][None]) * percent
                if first[at] == second[at]:
                    open_ &= a[:, None] < b[None]
                if not open_.any():
                    continue
                apart = np.bitwise_count(words[a - at][:, None] ^ words[b - at][None]).sum(axis=2, dtype=np.int64)
                x, y = np.nonzero(open_ & (apart <= both * (100 - percent) // (100 + percent)))
                left.append(a[x])
                right.append(b[y])
    one, other = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    nodes = rows.column("node")
    a, b = (nodes.take(pa.array(x)).to_pylist() for x in (one, other))
    pairs = [sorted(p) for p in zip(a, b, strict=True)]
    kind = rows.schema.field("node").type
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], ["a", "b"])


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Two documents link if their sets of ``k``-word shingles have a Jaccard of ``percent`` / 100 or more; a text of
    fewer words is one shingle. Null, empty and wordless texts have no shingles and link with nothing.
    Repeated rows give equal rows; a null doc_id has a null component. Ids are unique among different texts.
    Documents of equal words are one node, so a large group of copies costs no more than one of them. Other
    columns are ignored.
    """
    plain = docs.select("doc_id", "text")
    nodes = sketched(plain, k, percent, fold=True)
    of_text = plain.select("doc_id", folded_digest(F.coalesce("text", F.lit(""))).alias("digest")).join(
        nodes.select("digest", "node", "n"), "digest"
    )
    classes = classes_of(nodes.where("n > 0"), plain.withColumnRenamed("doc_id", "node"), k, percent)
    return (
        of_text.join(classes, "node", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), None)
            .when(F.col("n") > 0, F.coalesce("component", "node"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
    )


def classes_of(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Classes (node, component) of the nodes that are alike to another one."""
    texts = texts.where("node IS NOT NULL AND text IS NOT NULL")
    buckets = shared_buckets(nodes)
    hubs = written(hubs_of(buckets), "parity-hubs")
    links = written(verified(near_pairs(hub_pairs(buckets, hubs, percent), nodes, percent), texts, k, percent), "parity-links")
    classes = written(components(links), "parity-classes")
    late = written(verified(open_pairs(buckets, hubs, classes, nodes, percent), texts, k, percent), "parity-late")
    if late.limit(1).count():
        classes = written(components(links.union(late)), "parity-classes")
    return classes


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays.

    Rows that surely are no copies pass where they are read; only the others are joined with the ids to drop.
    Rows of a null doc_id and texts without words stay. Equal texts are left to exact dedup: they are found
    here too, as near copies, but are not folded first.
    """
    plain = docs.select("doc_id", "text")
    nodes = sketched(plain, k, percent, fold=False)
    classes = classes_of(nodes.where("n > 0"), plain.withColumnRenamed("doc_id", "node"), k, percent)
    dropped = classes.where("component <> node").select(F.col("node").alias("doc_id"))
    some, others = split_by_ids(docs, "doc_id", dropped)
    return others.union(some.join(dropped, "doc_id", "left_anti")).select(*(F.col(f"`{c}`") for c in docs.columns))

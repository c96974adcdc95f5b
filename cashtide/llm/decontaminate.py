"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search. Documents fall into classes by the number of their
shingles, each class twice as large as the one before. In a class of documents of up to ``u`` shingles a
signature has ``8 * u`` slots: a shingle belongs to the slot its hash names, and the slot keeps the
smallest hash. An item is looked up in the class of each document with its own signature of that many
slots. A shingle that document and item share is found unless a smaller hash of the document took its
slot, which happens to one in sixteen at most; an item that shares ``s`` shingles escapes with a chance
below ``16 ** -s``. Items of fewer than ``EXACT_BELOW`` shingles therefore get a slot per hash value, where
nothing can be displaced. Candidates are verified on the words themselves.

Items are the search set and come in blocks of bounded size; every block is sent to all tasks and
meets all documents in one scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cashtide.llm.wordhash import Words, shingle_hashes, shingle_set

#: ASCII apart from digits and letters parts words; all other bytes belong to them.
WORDS = Words(bytes(b for b in range(128) if not chr(b).isalnum()))

#: Words per shingle, and the share of an item's shingles a document must hold.
SHINGLE, CONTAINED = 5, 0.8

#: Slots per shingle of the largest document of a class; items below so many shingles are searched exactly.
SLOTS, EXACT_BELOW = 8, 12

#: Bytes of item text in one block.
BLOCK_BYTES = 8 << 20


class ItemIndex:
    """A block of items with their signatures per size class, made once per task and grown on demand."""

    def __init__(self, items: list[tuple[object, bytes]], k: int, threshold: float):
        self._k, self._threshold = k, threshold
        self._ids = [i for i, _ in items]
        self._texts = [t for _, t in items]
        self._hashes = [np.unique(shingle_hashes(WORDS.hashes(t), k)) for _, t in items]
        self._exact: dict[int, set] = {}
        short = [i for i, h in enumerate(self._hashes) if 0 < len(h) < EXACT_BELOW]
        self._short = self._postings({i: self._hashes[i] for i in short})
        self._classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _postings(hashes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes in order, and the item of each."""
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        values = np.concatenate(list(hashes.values()))
        owner = np.repeat(np.fromiter(hashes, np.int64), [len(h) for h in hashes.values()])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def _of_class(self, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        if size_class not in self._classes:
            slots = SLOTS << size_class
            self._classes[size_class] = self._postings(
                {i: signature(h, slots) for i, h in enumerate(self._hashes) if len(h) >= EXACT_BELOW}
            )
        return self._classes[size_class]

    def contained(self, text: bytes) -> list[tuple[object, int, int]]:
        """Items held by the document, each with its number of shingles and how many are shared."""
        hashes = np.unique(shingle_hashes(WORDS.hashes(text), self._k))
        if not len(hashes):
            return []
        size_class = int(len(hashes) - 1).bit_length()
        found = hits(self._of_class(size_class), signature(hashes, SLOTS << size_class)) | hits(self._short, hashes)
        kept, words = [], None
        for i in sorted(found):
            item = self._hashes[i]
            # A hash can only add to what is shared, so this never turns a true item away.
            if np.isin(item, hashes, assume_unique=True).sum() < self._threshold * len(item) - 1e-9:
                continue
            if words is None:
                words = shingle_set(WORDS.split(text), self._k)
            if i not in self._exact:
                self._exact[i] = shingle_set(WORDS.split(self._texts[i]), self._k)
            wanted = self._exact[i]
            shared = len(wanted & words)
            if shared >= self._threshold * len(wanted) - 1e-9:
                kept.append((self._ids[i], len(wanted), shared))
        return kept


def signature(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The smallest hash of each slot in use. ``hashes`` is sorted, so the first of a slot is the smallest."""
    slot = scatter(hashes) % np.uint64(slots)
    return hashes[np.unique(slot, return_index=True)[1]]


def scatter(hashes: np.ndarray) -> np.ndarray:
    """Slots are named by other bits than those that order the hashes."""
    return (hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(20)


def hits(postings: tuple[np.ndarray, np.ndarray], sought: np.ndarray) -> set[int]:
    """Items that have any of the sought hashes."""
    values, owner = postings
    if not len(values):
        return set()
    first = np.searchsorted(values, sought, "left")
    last = np.searchsorted(values, sought, "right")
    hit = np.flatnonzero(last > first)
    return {int(i) for at in hit for i in owner[first[at] : last[at]]}


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[Row]]:
    """The items, a bounded number of bytes at a time."""
    chosen = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = chosen.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        yield chosen.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()


def find(
    docs: DataFrame,
    items: DataFrame,
    k: int = SHINGLE,
    threshold: float = CONTAINED,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, n_item, n_shared, containment.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. ``n_item`` counts the item's
    distinct shingles; an item with fewer than ``k`` words is one shingle, and matches a document only if
    that has the same words and no more. Null, empty and wordless texts match nothing. Repeated rows of
    ``docs`` or ``items`` each give their own pairs. Other columns are ignored.
    """
    schema = (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, "
        "n_item bigint, n_shared bigint, containment double"
    )
    found = docs.sparkSession.createDataFrame([], schema)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    for block in blocks(items, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast([(row.item_id, row.text.encode()) for row in block])
        found = found.union(chosen.mapInArrow(_search(shared, k, threshold, items.schema[item_id].dataType), schema))
    return found


def _search(shared, k: int, threshold: float, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, k, threshold)
        for batch in batches:
            rows, pairs = [], []
            for at, text in enumerate(batch.column("text").cast(pa.binary())):
                for pair in index.contained(text.as_py()):
                    rows.append(at)
                    pairs.append(pair)
            n_item, n_shared = [p[1] for p in pairs], [p[2] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array([p[0] for p in pairs], id_kind),
                    pa.array(n_item, pa.int64()),
                    pa.array(n_shared, pa.int64()),
                    pa.array([s / n for s, n in zip(n_shared, n_item, strict=True)], pa.float64()),
                ],
                ["doc_id", "item_id", "n_item", "n_shared", "containment"],
            )

    return run


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = CONTAINED) -> DataFrame:
    """The documents that hold no item, with all their columns; null and empty texts stay.

    The text itself is judged where it is read, so no document is moved.
    """
    kept = docs
    for block in blocks(items, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast([(row.item_id, row.text.encode()) for row in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, k, threshold)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary())
                yield batch.filter(pa.array([not index.contained(t.as_py() or b"") for t in texts], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept

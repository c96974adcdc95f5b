"""Inverted lists of one shard: built in numpy, cut into blocks with their maxima, decoded a block at a time.

A shard is a bounded run of documents in the order of their ids. A list has the documents (by position in the
shard) and frequencies of a term, in blocks of ``BLOCK`` postings. A block's first byte says how wide gaps and
frequencies are; gaps and then frequencies follow, so one block is decoded by two ``frombuffer``. What search needs to
pass a block over stays outside: its last document and the largest impact in it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa

BLOCK = 128

#: Bytes of a text that are split at a time.
PIECE = 1 << 20

#: One impact: frequency over frequency plus length, in millionths of 1000.
SCORE_UNIT, TF_UNIT, LENGTH_UNIT = 1_000_000_000, 1000, 8

#: Terms are runs of letters, digits and everything beyond ASCII; only A-Z are lower-cased.
TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Widths of gaps and frequencies by code.
WIDTHS = (1, 2, 4, 8)


def term_counts(text: str) -> Counter:
    """Occurrences of every term of a text, as UTF-8 bytes; the text is split in bounded pieces."""
    data, found, at = text.encode().translate(TO_TERMS), Counter(), 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        end = len(data) if cut < 0 else cut
        found.update(data[at:end].split())
        at = end + 1
    return found


def length_norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``25 + (75 n N) div L``, exact also where the product passes 64 bits."""
    if len(lengths) and 75 * int(lengths.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(n) * documents // terms for n in lengths], np.int64)
    return 25 + 75 * lengths * documents // max(terms, 1)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return SCORE_UNIT * tf // (TF_UNIT * tf + LENGTH_UNIT * norms)


def _codes(most: np.ndarray) -> np.ndarray:
    return (most > 0xFF).astype(np.int64) + (most > 0xFFFF) + (most > 0xFFFFFFFF)


def packed(gaps: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each block begins and the last ends) of blocks that begin at ``starts``."""
    size = np.diff(np.append(starts, len(gaps)))
    codes = [_codes(np.maximum.reduceat(x, starts)) for x in (gaps, tf)]
    widths = [np.array(WIDTHS)[c] for c in codes]
    ends = np.cumsum(1 + size * (widths[0] + widths[1]))
    begins = np.concatenate([[0], ends])
    out = np.zeros(begins[-1], np.uint8)
    out[begins[:-1]] = codes[0] * 4 + codes[1]
    block = np.repeat(np.arange(len(starts)), size)
    within = np.arange(len(gaps)) - starts[block]
    base = begins[:-1] + 1
    for values, width, at in ((gaps, widths[0], base), (tf, widths[1], base + size * widths[0])):
        for w in np.unique(width):
            here = np.flatnonzero(width[block] == w)
            place = at[block[here]] + within[here] * w
            for byte in range(w):
                out[place + byte] = (values[here] >> (8 * byte)) & 0xFF
    return out, begins


def unpacked(data: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, frequencies) of one block; ``first`` is the document its first gap counts from."""
    w_gap, w_tf = WIDTHS[data[0] >> 2], WIDTHS[data[0] & 3]
    n = (len(data) - 1) // (w_gap + w_tf)
    gaps = np.frombuffer(data, f"<u{w_gap}", n, 1).astype(np.int64)
    tf = np.frombuffer(data, f"<u{w_tf}", n, 1 + n * w_gap).astype(np.int64)
    return first + np.cumsum(gaps), tf


@dataclass
class ShardLists:
    """All lists of a shard, as columns."""

    terms: list[bytes]
    df: np.ndarray
    top: np.ndarray
    block_ends: np.ndarray
    """Per list the number of blocks of it and all before it."""
    last: np.ndarray
    peak: np.ndarray
    data: np.ndarray
    begins: np.ndarray


class ShardBuilder:
    """Collects documents and makes their lists. Memory follows the distinct terms of its documents."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.postings: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        """A document without any term leaves no trace."""
        counts = term_counts(text)
        self.chars += len(text)
        if counts:
            vocabulary = self.vocabulary
            self.ids.append(doc_id)
            self.lengths.append(sum(counts.values()))
            terms = np.fromiter((vocabulary[t] for t in counts), np.int64, len(counts))
            self.postings.append(np.stack([terms, np.fromiter(counts.values(), np.int64, len(counts))]))

    def lists(self, documents: int, all_terms: int) -> tuple[list[int | None], np.ndarray, ShardLists]:
        """(document ids in order, their length norms, lists)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        norms = length_norms(np.array(self.lengths, np.int64)[order], documents, all_terms)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = np.repeat(rank, [p.shape[1] for p in self.postings])
        term, tf = np.concatenate(self.postings, axis=1)
        by_term = np.lexsort((doc, term))
        doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        df = np.bincount(term)
        start = np.cumsum(df) - df
        within = np.arange(len(term)) - start[term]
        blocks = np.flatnonzero(within % BLOCK == 0)
        gaps = np.diff(doc, prepend=-1)
        gaps[start] = doc[start] + 1
        impact = impacts(tf, norms[doc])
        data, begins = packed(gaps, tf, blocks)
        found = ShardLists(
            list(self.vocabulary),
            df,
            np.maximum.reduceat(impact, start),
            np.cumsum(-(-df // BLOCK)),
            doc[np.append(blocks[1:], len(doc)) - 1],
            np.maximum.reduceat(impact, blocks),
            data,
            begins,
        )
        return [self.ids[i] for i in order], norms, found


_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())
INDEX_TYPES = pa.schema(
    [("shard", _LONG), ("term", pa.string()), ("df", _LONG), ("top", _LONG)]
    + [("last", _LONGS), ("peak", _LONGS), ("sizes", _LONGS), ("data", pa.binary())]
)


def index_rows(shard: int, builder: ShardBuilder, documents: int, all_terms: int) -> list[pa.RecordBatch]:
    """Index rows of a shard: a row without a term, which has the documents' ids and length norms in the place of
    ``last`` and ``peak``, and a row for each term."""
    ids, norms, found = builder.lists(documents, all_terms)
    n = len(found.terms)
    edges = np.concatenate([[0], found.block_ends])
    columns = [
        pa.array(np.full(n, shard, np.int64)),
        pa.array(found.terms, pa.binary()).cast(pa.string()),
        pa.array(found.df, pa.int64()),
        pa.array(found.top, pa.int64()),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.last, pa.int64())),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.peak, pa.int64())),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.diff(found.begins), pa.int64())),
        pa.Array.from_buffers(
            pa.binary(), n, [None, pa.py_buffer(found.begins[edges].astype(np.int32).tobytes()), pa.py_buffer(found.data.tobytes())]
        ),
    ]
    head = [[shard], [None], [len(ids)], [None], [ids], [norms.tolist()], [None], [None]]
    first = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(head, INDEX_TYPES)], schema=INDEX_TYPES)
    rest = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, INDEX_TYPES)], schema=INDEX_TYPES)
    return [first, rest]

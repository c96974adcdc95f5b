"""Block-Max MaxScore over the lists of one shard.

Documents are taken in stretches of rising position. With the k-th best score so far as threshold, lists whose upper
bounds together do not pass it are non-essential: a document found in them alone cannot enter. The other lists
are decoded over the stretch and make the candidates. Then the non-essential lists are gone through from the
highest bound down: the maxima of the blocks a candidate would lie in, known without decoding, bound what it
can still get; only blocks that hold a candidate beyond the threshold are decoded.

Positions follow document ids, so of equal scores the earlier one stays and a later document needs more than the
threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cashtide.llm.postings import BLOCK, impacts, unpacked

#: Documents of the first stretch, which only finds a threshold, and of the longest.
FIRST_STRETCH, STRETCH = 512, 8192


@dataclass
class PostingList:
    """A term's list; blocks are decoded when asked for and kept while the shard is searched."""

    df: int
    top: int
    last: np.ndarray
    peak: np.ndarray
    begins: np.ndarray
    data: bytes
    norms: np.ndarray
    docs: np.ndarray = field(init=False)
    impact: np.ndarray = field(init=False)
    decoded: np.ndarray = field(init=False)

    def __post_init__(self):
        self.docs = np.empty(self.df, np.int32)
        self.impact = np.empty(self.df, np.int32)
        self.decoded = np.zeros(len(self.last), bool)

    def decode(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.decoded[blocks]]:
            docs, tf = unpacked(self.data[self.begins[b] : self.begins[b + 1]], int(self.last[b - 1]) if b else -1)
            here = slice(b * BLOCK, b * BLOCK + len(docs))
            self.docs[here], self.impact[here] = docs, impacts(tf, self.norms[docs])
            self.decoded[b] = True

    def between(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, impacts) of the documents from ``start`` to before ``end``."""
        low, high = np.searchsorted(self.last, (start, end - 1))
        high = min(high + 1, len(self.last))
        self.decode(np.arange(low, high))
        docs = self.docs[low * BLOCK : high * BLOCK]
        a, b = np.searchsorted(docs, (start, end))
        return docs[a:b], self.impact[low * BLOCK : high * BLOCK][a:b]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, its largest impact) that each of the rising ``docs`` would lie in; 0 behind the last block."""
        block = np.searchsorted(self.last, docs)
        return block, np.append(self.peak, 0)[block]

    def look_up(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of the rising ``docs`` in their blocks, 0 where the list lacks one."""
        needed = np.unique(block)
        self.decode(needed)
        places = (needed[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        places = places[places < self.df]
        held = self.docs[places]
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, self.impact[places[at]], 0).astype(np.int64)


def best(query: list[tuple[PostingList, int]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the ``k`` best documents of a shard, best first, equal scores by position.

    ``query`` has lists with their weights; a document's score is the sum of weight times impact and must be above 0.
    """
    ordered = sorted(((plist, weight) for plist, weight in query if weight > 0), key=lambda x: x[0].top * x[1])
    below = np.cumsum([plist.top * weight for plist, weight in ordered], dtype=np.int64)
    found, scores, threshold = np.empty(0, np.int64), np.empty(0, np.int64), 0
    start, stretch = 0, FIRST_STRETCH
    while start < documents and len(ordered) and below[-1] > threshold:
        end = min(start + stretch, documents)
        essential = int(np.searchsorted(below, threshold, side="right"))
        sums = np.zeros(end - start, np.int64)
        for plist, weight in ordered[essential:]:
            docs, impact = plist.between(start, end)
            sums[docs - start] += weight * impact.astype(np.int64)
        candidates = np.flatnonzero(sums)
        docs, got = candidates + start, sums[candidates]
        docs, got = _complete(ordered[:essential], docs, got, threshold)
        new = got > threshold
        if new.any():
            found, scores = np.concatenate([found, docs[new]]), np.concatenate([scores, got[new]])
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            threshold = int(scores[-1]) if len(scores) == k else 0
        start, stretch = end, min(stretch * 2, STRETCH)
    return found, scores


def _complete(lists: list[tuple[PostingList, int]], docs: np.ndarray, got: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that may pass the threshold, with what the non-essential ``lists`` add to them."""
    rest = sum(plist.top * weight for plist, weight in lists)
    may = got + rest > threshold
    docs, got = docs[may], got[may]
    if not lists or not len(docs):
        return docs, got
    places, most = zip(*(plist.bounds(docs) for plist, _ in lists))
    limit = np.cumsum([peak.astype(np.int64) * weight for peak, (_, weight) in zip(most, lists)], axis=0)
    alive = np.arange(len(docs))
    for i in range(len(lists) - 1, -1, -1):
        alive = alive[got[alive] + limit[i][alive] > threshold]
        if not len(alive):
            break
        plist, weight = lists[i]
        here = alive[most[i][alive] > 0]
        if len(here):
            got[here] += weight * plist.look_up(docs[here], places[i][here])
    return docs[alive], got[alive]

"""Quality classifier: a byte-level convolutional network over the whole document, in numpy.

A document is cut into chunks of ``CHUNK`` bytes that overlap by a window, so every window of the document
lies in some chunk. A window of ``WINDOW`` bytes, every ``STRIDE`` bytes, is embedded byte by byte and goes through
``FILTERS`` learned filters; a chunk keeps the largest answer of each filter. The chunks of a document are
combined twice, as the largest and as the mean of what they kept, and a logistic unit makes one probability of
that. Everything is trained together by stochastic gradient descent with momentum on a sample of labelled rows
whose bound is a parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.tables import split_by_ids, written

WINDOW, STRIDE, WIDTH, FILTERS = 8, 4, 4, 16

#: Bytes a chunk starts after the one before, and its length: the next chunk's first window overlaps it.
STEP = 512
CHUNK = STEP + WINDOW

#: Labelled documents a model is fitted on, about, half of them of either label, and chunks that each teaches with:
#: of a longer one as many as this, one from each of equal stretches of the whole text. Scoring knows no such bound.
SAMPLE_ROWS, SAMPLE_CHUNKS = 1_600, 32

EPOCHS, BATCH, RATE, MOMENTUM = 8, 16, 0.05, 0.9

#: Chunks that go through the filters at once.
TOGETHER = 256


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray

    @staticmethod
    def random(rng: np.random.Generator) -> Network:
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        embedding = rng.normal(0, 1, (256, WIDTH)).astype(np.float32)
        return Network(embedding, draw(WINDOW * WIDTH, FILTERS), np.zeros(FILTERS, np.float32), draw(2 * FILTERS), np.zeros(1, np.float32))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.output, self.offset]


def chunks(text: bytes) -> np.ndarray:
    """All chunks of the text as rows; the end is filled with zero bytes, an empty text is one chunk of them."""
    n = max(1, -(-len(text) // STEP))
    raw = np.zeros(n * STEP + WINDOW, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[::STEP]


def windows(rows: np.ndarray) -> np.ndarray:
    """The bytes of every window of every chunk."""
    return np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)[:, ::STRIDE]


def answers(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest answer of each filter in each chunk, and the window that gave it."""
    seen = windows(rows)
    embedded = net.embedding[seen].reshape(-1, WINDOW * WIDTH)
    out = (embedded @ net.filters).reshape(len(rows), -1, FILTERS)
    first = out.argmax(axis=1)
    top = np.take_along_axis(out, first[:, None], axis=1)[:, 0] + net.bias
    return np.maximum(top, 0), first


def score(net: Network, text: bytes) -> float:
    """The probability of a text, whatever its length; chunks are read ``TOGETHER`` at a time."""
    rows = chunks(text)
    most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
    for at in range(0, len(rows), TOGETHER):
        top, _ = answers(net, rows[at : at + TOGETHER])
        most = np.maximum(most, top.max(axis=0))
        total += top.sum(axis=0)
    combined = np.concatenate([most, (total / len(rows)).astype(np.float32)])
    return float(sigmoid(combined @ net.output + net.offset[0]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def some_chunks(text: bytes, most: int = SAMPLE_CHUNKS) -> np.ndarray:
    """All chunks of a text, or of a longer one ``most``: one from each of ``most`` equal stretches, drawn by its bytes."""
    rows = chunks(text)
    if len(rows) <= most:
        return rows
    edges = np.linspace(0, len(rows), most + 1).astype(np.int64)
    return rows[np.random.default_rng(zlib.crc32(text)).integers(edges[:-1], edges[1:])]


def train(cut: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Network:
    """Fit on the chunks of documents by gradient descent; a filter learns from the window that won its chunk."""
    rng = np.random.default_rng(seed)
    net = Network.random(rng)
    speed = [np.zeros_like(p) for p in net.parts]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(cut))
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            slopes = gradient(net, [cut[i] for i in some], labels[some])
            for part, v, slope in zip(net.parts, speed, slopes, strict=True):
                v *= np.float32(MOMENTUM)
                v -= rate * slope
                part += v
    return net


def gradient(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean log loss over a few documents, in the order of ``Network.parts``."""
    rows = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    top, first = answers(net, rows)
    most = np.maximum.reduceat(top, begin, axis=0)
    mean = np.add.reduceat(top, begin, axis=0) / sizes[:, None]
    combined = np.concatenate([most, mean], axis=1)
    wrong = ((sigmoid(combined @ net.output + net.offset[0]) - labels) / len(texts)).astype(np.float32)
    back = wrong[:, None] * net.output
    owner = np.repeat(np.arange(len(texts)), sizes)
    of_top = (back[:, FILTERS:] / sizes[:, None])[owner]
    winner = top == most[owner]
    of_top = of_top + back[:, :FILTERS][owner] * winner / np.maximum(np.add.reduceat(winner, begin, axis=0), 1)[owner]
    of_top = (of_top * (top > 0)).astype(np.float32)
    # The bytes of the winning window of every chunk and filter.
    won = windows(rows)[np.arange(len(rows))[:, None], first]
    embedded = net.embedding[won].reshape(len(rows), FILTERS, WINDOW * WIDTH)
    of_filters = np.einsum("cfk,cf->kf", embedded, of_top)
    of_bytes = (of_top[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH)
    of_embedding = np.stack([np.bincount(won.ravel(), of_bytes[:, k], 256) for k in range(WIDTH)], axis=1)
    slopes = [of_embedding, of_filters, of_top.sum(axis=0), combined.T @ wrong, wrong.sum(keepdims=True)]
    norm = np.sqrt(sum(float((s**2).sum()) for s in slopes))
    return [(s / max(1.0, norm)).astype(np.float32) for s in slopes]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Fit on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0 or 1) names.

    The sample takes ids by a hash, about as many of either label, and of each at most ``SAMPLE_CHUNKS`` chunks, however
    long its text is; so it is bounded for any ids and texts. An id with several texts teaches the least of
    them, one with both labels teaches 0; labels without a text and null labels teach nothing. With one
    label or none the network scores by what it has.
    """
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = dict(marked.groupBy("quality").count().collect())
    chance = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / F.lit(1 << 20)
    share = F.when(F.col("quality") == 1, rows / 2 / max(sizes.get(1, 0), 1)).otherwise(rows / 2 / max(sizes.get(0, 0), 1))
    chosen = marked.where(chance < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [some_chunks(text.as_py()).tobytes() for text in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(taken, pa.binary())], ["doc_id", "quality", "cut"])

    # Only the texts of the sample are moved.
    near = split_by_ids(docs.select("doc_id", "text").where("text IS NOT NULL"), "doc_id", chosen.select("doc_id"))[0]
    one = near.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    kinds = [f"{c} {one.schema[c].dataType.simpleString()}" for c in ("doc_id", "quality")]
    stored = written(one.mapInArrow(cut, ", ".join([*kinds, "cut binary"])), "quality-sample")
    taught = stored.orderBy("doc_id").collect()
    held = [np.frombuffer(r.cut, np.uint8).reshape(-1, CHUNK) for r in taught]
    return train(held, np.array([r.quality for r in taught], np.float32))


def rate(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` with ``score``, the probability of quality 1, and ``predicted``, 1 from 0.5 on.

    The whole text is scored, and nothing but the text; null counts as empty. Columns of these names are replaced.
    """
    added = ("score", "predicted")
    kept = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(net.parts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value)
        for batch in batches:
            found = [score(own, text.as_py() or b"") for text in batch.column("_text").cast(pa.binary())]
            made = [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").alias("_text")).mapInArrow(
        scored, ", ".join([*fields, "score double", "predicted int"])
    )

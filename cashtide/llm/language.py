"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's subwords are its runs of ``GRAMS`` bytes, upper case folded and everything but letters made a blank.
Each is hashed to a row of an embedding table; the mean of the rows of the whole text goes through a
linear softmax. Table and softmax are trained together by stochastic gradient descent in numpy, on a
sample of labelled rows whose bound is a parameter. A part of the sample is held back to calibrate: a
temperature makes the confidence honest, and a text is rejected if its confidence is below what all but
``REJECTED`` of the rightly named held-back texts reach, and no language has half of the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.tables import written

#: Subword lengths in bytes, rows of the embedding table (a power of two), and its width.
GRAMS, ROWS, WIDTH = (2, 3, 4), 1 << 14, 16

#: Labelled rows a model is fitted on, about, shared evenly by the languages.
SAMPLE_ROWS = 1_600

EPOCHS, BATCH, RATE = 8, 32, 40.0

#: The share of clean texts that may be rejected; none is whose likeliest language is surer than this.
REJECTED, SURE = 0.001, 0.5

UNKNOWN = "und"

#: Bytes of text embedded at once.
PIECE = 1 << 20


def _folding() -> bytes:
    """ASCII letters become lower case, other ASCII a blank; bytes of longer characters stay."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


FOLDED = _folding()


def subword_counts(text: bytes) -> np.ndarray:
    """How often each row of the table occurs in the whole text, read in pieces that overlap."""
    counts = np.zeros(ROWS, np.int64)
    reach = max(GRAMS) - 1
    for at in range(0, max(len(text), 1), PIECE):
        raw = np.frombuffer((b" " + text[at : at + PIECE + reach] + b" ").translate(FOLDED), np.uint8).astype(np.uint32)
        for n in GRAMS:
            counts += np.bincount(hashed(raw, n), minlength=ROWS)
    return counts


def hashed(raw: np.ndarray, n: int) -> np.ndarray:
    """The table row of every run of ``n`` bytes."""
    if len(raw) < n:
        return np.empty(0, np.int64)
    mixed = np.full(len(raw) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        mixed = (mixed ^ raw[i : len(raw) - n + 1 + i]) * np.uint32(0x01000193)
        mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(ROWS - 1)).astype(np.int64)


@dataclass
class Model:
    """``weights`` is table times softmax: with nothing between, a subword's logits can be kept ready."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def confidences(self, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities for rows of subword counts."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return softmax(((counts @ self.weights) / total + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of (doc_id, mark, text, lang), as many of each language where there are enough.

    A row belongs if a hash of its id and text falls below the share its language is given; the same rows at any
    partitioning. Ids may repeat or be null; rows that are equal in id and text (``mark`` is its hash) are taken once.
    Counting the languages brings one row per language to the driver.
    """
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return labelled.limit(0).select("doc_id", F.lit(0).cast("long").alias("mark"), "text", "lang")
    each = rows / len(sizes)
    shares = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = labelled.where(chance < shares[F.col("lang")]).withColumn("mark", F.xxhash64("text"))
    return chosen.groupBy("doc_id", "mark", "lang").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang); null texts and languages teach nothing.

    Only the subword counts of the sample come to the driver, at most ``ROWS`` per text however long it is.
    """
    chosen = sample(labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL"), rows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in batch.column("text").cast(pa.binary()):
                counts = subword_counts(text.as_py())
                at.append(np.flatnonzero(counts).astype(np.int16 if ROWS <= 1 << 15 else np.int32))
                n.append(counts[at[-1]].astype(np.float32))
            columns = [batch.column("lang"), batch.column("doc_id"), batch.column("mark"), pa.array(at, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "doc_id", "mark", "at", "n"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    stored = written(chosen.mapInArrow(counted, f"lang string, doc_id {kind}, mark bigint, at array<smallint>, n array<float>"), "language-sample")
    rows_read = stored.orderBy("doc_id", "lang", "mark").toArrow().to_pydict()
    return train(rows_read["lang"], rows_read["at"], rows_read["n"], seed)


def train(langs: list[str], at: list, n: list, seed: int) -> Model:
    """Stochastic gradient descent on sparse subword counts, then calibration on the fifth held back."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0, np.float32))
    texts = [(np.asarray(a, np.int64), np.asarray(c, np.float32) / max(sum(c), 1)) for a, c in zip(at, n, strict=True)]
    truth = np.array([languages.index(lang) for lang in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, taught = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.normal(0, 1 / WIDTH, (ROWS, WIDTH)).astype(np.float32)
    linear = rng.normal(0, 1 / WIDTH, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for start in range(0, len(taught), BATCH):
            some = taught[start : start + BATCH]
            rows = np.concatenate([texts[i][0] for i in some])
            share = np.concatenate([texts[i][1] for i in some])[:, None]
            ends = np.cumsum([0, *(len(texts[i][0]) for i in some)])
            mean = np.stack([(table[rows[a:b]] * share[a:b]).sum(axis=0) for a, b in zip(ends, ends[1:], strict=False)])
            wrong = softmax(mean @ linear + bias)
            wrong[np.arange(len(some)), truth[some]] -= 1
            wrong /= len(some)
            back = (wrong @ linear.T).astype(np.float32)
            linear -= rate / 40 * (mean.T @ wrong).astype(np.float32)
            bias -= rate / 40 * wrong.sum(axis=0)
            for a, b, own in zip(ends, ends[1:], back, strict=False):  # a text's rows are distinct
                table[rows[a:b]] -= rate * share[a:b] * own
        taught = rng.permutation(taught)
    model = Model(languages, table @ linear, bias)
    return calibrated(model, [texts[i] for i in held], truth[held])


def calibrated(model: Model, texts: list, truth: np.ndarray) -> Model:
    """Set the temperature of least log loss, and the confidence below which a text is rejected."""
    if not len(truth):
        return model
    logits = np.stack([(model.weights[a] * s[:, None]).sum(axis=0) + model.bias for a, s in texts])
    here = np.arange(len(truth))

    def loss(temperature: float) -> float:
        return -np.log(np.maximum(softmax(logits / temperature)[here, truth], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.2, 5, 33), key=loss))
    confidence = softmax(logits / model.temperature)
    right = confidence.argmax(axis=1) == truth
    if right.any():
        model.least = min(SURE, float(np.quantile(confidence[here, truth][right], REJECTED)))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def judgements(own: Model, texts: pa.Array, lettered: pa.Array) -> list[tuple[str, float, bool]]:
    """Language, confidence and whether it is rejected, for each text."""
    found = []
    for text, spoken in zip(texts.cast(pa.binary()), lettered, strict=True):
        if spoken.as_py() and own.languages:
            sure = own.confidences(subword_counts(text.as_py())[None, :].astype(np.float32))[0]
            best = int(sure.argmax())
            found.append((own.languages[best], float(sure[best]), bool(sure[best] < own.least)))
        else:
            found.append((UNKNOWN, 0.0, True))
    return found


def _shared(docs: DataFrame, model: Model):
    plain = (model.languages, model.weights, model.bias, model.temperature, model.least)
    return docs.sparkSession.sparkContext.broadcast(plain)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns only. Texts are judged in place."""
    shared = _shared(docs, model)
    last = len(docs.columns)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            kept = pa.array([not away for _, _, away in judgements(own, batch.column(last), batch.column(last + 1))], pa.bool_())
            yield batch.select(list(range(last))).filter(kept)

    text = F.col("text")
    return docs.select("*", text.alias("_text"), has_letter(text).alias("_lettered")).mapInArrow(judged, docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    ``lang_pred`` is one of the languages learned; ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned. ``score`` is the calibrated confidence. Rejected are ``und`` and texts whose confidence is
    below the calibrated one. The text alone is judged. Columns of ``docs`` with these names are replaced.
    """
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in added]
    shared = _shared(docs, model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            found = judgements(own, batch.column("_text"), batch.column("_lettered"))
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    schema = ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"])
    text = F.col("text")
    return docs.select(
        *(F.col(f"`{c}`") for c in kept), text.alias("_text"), has_letter(text).alias("_lettered")
    ).mapInArrow(judged, schema)

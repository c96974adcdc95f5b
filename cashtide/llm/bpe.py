"""Byte-level BPE by dynamic programming over prefixes: one last token per prefix, no merging loop.

For every prefix of a piece of text exactly one token can end its encoding. A token that matches
a suffix of the prefix is that token if it may follow the last token of what stands before it. A suffix
automaton over the vocabulary lists the matches; whether two tokens may stand side by side is decided
from the merge ranks alone; back-pointers give the ids. The work is linear in the text, also for a
single word of a million bytes.

Results are those of the public tokenizer file: its pre-tokeniser splits the text, its added tokens
are matched literally before that, and ids are merge results in rank order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces up to this many characters are remembered, so many at most; the rest is worked out again.
#: With all of them, and as many pairs of tokens, a codec was measured at 76 MB; with 100,000 at 49 MB, but half as slow again.
REMEMBERED_CHARS, REMEMBERED = 48, 250_000


def byte_of_symbol() -> dict[str, int]:
    """The format's printable stand-ins for bytes: visible Latin-1 stays, the rest is numbered from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: The pre-tokeniser's pattern: a fixed value of the public byte-level format.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def splitter() -> Callable[[str], list[str]]:
    """The pre-tokeniser. Up to U+FFFF its classes are written as ranges, which is twice as fast."""
    import regex

    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letter, number, space = (
        "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(f"{name}+", plane))
        for name in (r"\p{L}", r"\p{N}", r"\s")
    )
    in_plane = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    ).findall
    anywhere = regex.compile(PIECES).findall

    def split(text: str) -> list[str]:
        return in_plane(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else anywhere(text)

    return split


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs of a tokenizer file: the bytes of each id, the merges by rank, added tokens."""

    tokens: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        """Read on the driver; a vocabulary is some ten thousand entries, whatever the corpus."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file with its own pattern is needed")
        if spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("normalisers and prefix spaces are not supported")
        symbol = byte_of_symbol()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ids = {t: i for t, i in model["vocab"].items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return Vocabulary(
            {i: bytes(symbol[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in added.items()},
            [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
            added,
        )


class Codec:
    """Encoder and decoder; made once per task."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self._bytes = vocabulary.tokens
        self._rank = {(a, b): r for r, (a, b, _) in enumerate(vocabulary.merges)}
        self._born = {made: r for r, (_, _, made) in enumerate(vocabulary.merges)}
        self._parts = {made: (a, b) for a, b, made in vocabulary.merges}
        self._matches = ahocorasick.Automaton()
        special = set(vocabulary.added.values())
        for i, token in vocabulary.tokens.items():
            # Bytes without a merge are the alphabet; a longer token that no merge makes cannot occur.
            if i not in special and (len(token) == 1 or i in self._born):
                self._matches.add_word(token.decode("latin-1"), (i, len(token)))
        self._matches.make_automaton()
        self._split = splitter()
        self._added = vocabulary.added
        literals = sorted(vocabulary.added, key=len, reverse=True)
        self._literal = re.compile("(" + "|".join(map(re.escape, literals)) + ")") if literals else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side.

        Undo the merges of both around the seam, latest first. A pair seen there was a possible merge
        while both of its tokens stood; it would have been made if its rank came before the merge
        that ended that state.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, before, by_left, fits = left, right, len(self._rank), False, True
        while True:
            rank = self._rank.get((a, b))
            # At equal rank the leftmost pair merges first, which only the left token's own merge is.
            if rank is not None and (rank < before or rank == before and not by_left):
                fits = False
                break
            born_a, born_b = self._born.get(a, -1), self._born.get(b, -1)
            if born_a < 0 and born_b < 0:
                break
            # Of two equal merges the left one was made first, so the right one is undone first.
            by_left = born_a > born_b
            if by_left:
                before, a = born_a, self._parts[a][1]
            else:
                before, b = born_b, self._parts[b][0]
        if len(self._fits) < REMEMBERED:
            self._fits[left, right] = fits
        return fits

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the pre-tokeniser."""
        known = self._known.get(text)
        if known is not None:
            return known
        raw = text.encode().decode("latin-1")
        last = [-1] * (len(raw) + 1)
        width = [0] * (len(raw) + 1)
        for at, (token, size) in self._matches.iter(raw):
            end = at + 1
            if last[end] < 0 and (size == end or self.may_follow(last[end - size], token)):
                last[end], width[end] = token, size
        ids, end = [], len(raw)
        while end:
            ids.append(last[end])
            end -= width[end]
        found = tuple(reversed(ids))
        if len(text) <= REMEMBERED_CHARS and len(self._known) < REMEMBERED:
            self._known[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for run in self._literal.split(text) if self._literal else [text]:
            if run in self._added:
                ids.append(self._added[run])
            else:
                known, piece = self._known.get, self.piece
                for word in self._split(run):
                    ids.extend(known(word) or piece(word))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode(errors="replace")


#: Broadcast vocabularies of the running application, by digest. Workers keep a codec beside each broadcast, so
#: one broadcast for every call would leave one codec for every call in them.
_SENT: dict[tuple[str, str], Broadcast] = {}


def _shared(docs: DataFrame, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary as plain values, broadcast once an application: its size is that of the tokenizer file."""
    parts = {"tokens": vocabulary.tokens, "merges": vocabulary.merges, "added": vocabulary.added}
    context = docs.sparkSession.sparkContext
    known = context.applicationId, hashlib.sha256(repr([list(x.items()) if isinstance(x, dict) else list(x) for x in parts.values()]).encode()).hexdigest()
    if known not in _SENT:
        for other in [x for x in _SENT if x[0] != known[0]]:  # of applications that have ended
            del _SENT[other]
        _SENT[known] = context.broadcast(parts)
    return _SENT[known]


def _codec(parts: dict) -> Codec:
    """The codec of this Python worker: later tasks find it, and the pieces it knows, beside the broadcast."""
    if "codec" not in parts:
        parts["codec"] = Codec(Vocabulary(parts["tokens"], parts["merges"], parts["added"]))
    return parts["codec"]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the exact token ids of the whole text. Null and empty texts have no ids."""
    return _with_column(docs, vocabulary, "ids", "array<int>", lambda codec, row: codec.encode(row or ""), text)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of the ids. Null ids give an empty text."""
    return _with_column(docs, vocabulary, "decoded", "string", lambda codec, row: codec.decode(row or ()), ids)


def _with_column(docs, vocabulary, name, kind, work, source):
    kept = [c for c in docs.columns if c != name]
    shared = _shared(docs, vocabulary)
    arrow = pa.list_(pa.int32()) if kind == "array<int>" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            made = pa.array([work(codec, x) for x in batch.column("_in").to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name), f"`{name}` {kind}"])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`").alias("_in")).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them.

    One row per row of ``docs``, in whatever order. A null text counts as empty: no ids, and the digests
    of nothing. Other columns of ``docs`` are ignored, so clashing names do not matter.
    """
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        decimal = {i: str(i) for i in shared.value["tokens"]}.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):  # one at a time: a batch may hold many long texts
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                of_text.append(sha(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

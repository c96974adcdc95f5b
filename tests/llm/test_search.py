"""Ranked search: brute force over all documents, packed blocks, what is not decoded, hostile rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cashtide.llm import maxscore, postings, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, term string, shard string, df string, query string"
ITEMS = "item_id long, text string, query string, score string"


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def by_hand(docs, items, k):
    split = [(i, Counter(terms_of(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    found = []
    for item, text in items:
        scores = []
        for doc_id, counts in split:
            m = 25 + 75 * sum(counts.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in terms_of(text)
                if t in counts
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        found += [(item, rank, None if lost else d, -s) for rank, (s, lost, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


def run(spark, docs, items, k=10, parts=3, **sizes):
    table = spark.createDataFrame([(i, t, "x", "y", "z", "q") for i, t in docs], DOCS).repartition(parts)
    index = search.build(table, **sizes)
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    rows = search.search(index, asked, k, block_chars=60)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "İx", "a1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return lambda n: " ".join(rng.choices(vocabulary, weights, k=n))


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 40}, {"shard_chars": 500}])
def test_against_brute_force(spark, words, sizes):
    rng = random.Random(9)
    docs = [(i, words(rng.randrange(1, 60))) for i in range(400)]
    docs += [(7, "hot W0! copy")] * 150 + [(None, words(20)), (500, None), (501, ""), (502, " .,-\n"), (3, words(10)), (503, words(30_000))]
    items = [(i, words(rng.randrange(1, 30))) for i in range(12)]
    items += [(20, "hot"), (20, "COPY w0 hot"), (21, None), (22, ""), (23, "unheard"), (None, "w1 w1 w2-w3"), (24, "hot"), (24, "hot")]
    assert run(spark, docs, items, k=4, **sizes) == by_hand(docs, items, 4)


def test_terms(spark):
    text = "Ünï_A1-b\x7fC…d É\x00日本 ONE'two  "
    assert {t.decode(): n for t, n in postings.term_counts(text).items()} == Counter(terms_of(text))
    row = spark.createDataFrame([(text,), ("...",), ("",), (None,)], "text string").select(search.n_terms(search.F.col("text")).alias("n"), search.lower_terms(search.F.col("text")).alias("t")).collect()
    assert [r.n for r in row] == [len(terms_of(text)), 0, 0, 0] and row[0].t == terms_of(text)
    long_text = ("a" * 30 + " b ") * (postings.PIECE // 10)
    assert postings.term_counts(long_text) == {b"a" * 30: postings.PIECE // 10, b"b": postings.PIECE // 10}


def test_nothing_to_search(spark):
    docs, items = [(1, "a b"), (2, "c")], [(1, "a")]
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None), (2, "-")], items) == []
    assert run(spark, docs, items) == by_hand(docs, items, 10)


def test_blocks_come_back_as_packed():
    rng = np.random.default_rng(1)
    gaps = rng.integers(1, [200, 60_000, 3_000_000, 1 << 40], (300, 4)).T.ravel()
    tf = rng.integers(1, [5, 300, 70_000, 1 << 33], (300, 4)).T.ravel()
    starts = np.sort(np.append(rng.choice(np.arange(1, 1200), 30, replace=False), 0))
    data, begins = postings.packed(gaps, tf, starts)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], 1200])):
        docs, found = postings.unpacked(data[begins[i] : begins[i + 1]].tobytes(), 10)
        assert docs.tolist() == (10 + np.cumsum(gaps[a:b])).tolist() and found.tolist() == tf[a:b].tolist()


def test_length_norms_beyond_64_bits():
    lengths = np.array([1, 10**9, 7 * 10**9])
    assert postings.length_norms(lengths, 10**10, 10**13).tolist() == [25 + 75 * int(n) * 10**10 // 10**13 for n in lengths]


def lists_of(spark, texts):
    builder = postings.ShardBuilder()
    for i, text in enumerate(texts):
        builder.add(i, text)
    rows = postings.index_rows(0, builder, len(texts), sum(builder.lengths))
    return search._opened(search.pa.Table.from_batches(rows))


def test_blocks_without_a_chance_are_not_decoded(spark):
    """Two rare terms lead; of the frequent one only blocks with a candidate beyond the threshold are needed."""
    n = 40_000
    texts = ["often" for _ in range(n)]
    for i in (*range(20), 20_000, 39_000):
        texts[i] = "often rare seldom"
    texts[25_000] = "rare"
    ids, norms, held = lists_of(spark, texts)
    query = [(held["often"], 1), (held["rare"], 900), (held["seldom"], 900)]
    docs, scores = maxscore.best(query, n, 10)
    assert docs.tolist() == list(range(10)) and (scores > 0).all()
    blocks = held["often"].decoded
    assert blocks[:4].all() and blocks.sum() <= 4 + 2 < len(blocks) / 50
    held["often"].decoded[:] = False
    every, _ = maxscore.best(query, n, n)
    assert len(every) == n and held["often"].decoded.all()


def test_bounds_and_look_up():
    ids, norms, held = lists_of(None, ["a" + " b" * (i % 7) for i in range(1000)])
    plist = held["b"]
    docs = np.array([0, 1, 7, 500, 501, 999])
    block, peak = plist.bounds(docs)
    got = plist.look_up(docs, block)
    want = [postings.impacts(np.int64(i % 7), norms[i]) if i % 7 else 0 for i in docs]
    assert got.tolist() == want and (got <= peak).all()

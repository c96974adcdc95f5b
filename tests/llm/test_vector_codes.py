"""Vector codes: exact products, brute force in plain integers, hostile rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cashtide.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label string, code string, of string, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], ROWS)


def by_hand(rows, parts, entries, rounds, scale=256):
    """(code, error) per row and the books' digest, with Python's unbounded integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    start = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[least[i][p * width : (p + 1) * width] for i in start] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            books[p] = [
                [sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])
            ]
    found = []
    for i, v, label in kept:
        best = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return found, digest


@pytest.mark.parametrize("size", [3, 1 << 13, 1 << 28])
def test_products_of_limbs_are_exact(size):
    rng = random.Random(size)
    left = np.array([[rng.randrange(-size, size) for _ in range(6)] for _ in range(40)])
    right = np.array([[rng.randrange(-size, size) for _ in range(30)] for _ in range(6)])
    exact = [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in right.T] for row in left]
    for bits in (None, 5, 20):
        assert vector_codes.exact_dot(left, right, bits).tolist() == exact


def test_limbs_stay_below_the_exact_bound():
    for width in (1, 4, 5, 1000, 1 << 20):
        bits = vector_codes.limb_bits(width)
        assert width * (1 << (bits - 1)) ** 2 < 1 << vector_codes.EXACT_BITS <= width * (1 << (bits + 1)) ** 2 * 2
    pieces = vector_codes.limbs(np.array([-(1 << 40) - 3, 77, 0]), 9)
    assert all(np.abs(x).max() <= 256 for x in pieces)
    assert sum(x.astype(np.int64) << (9 * i) for i, x in enumerate(pieces)).tolist() == [-(1 << 40) - 3, 77, 0]


def test_against_plain_integers(spark):
    rng = random.Random(5)
    rows = [(i % 90, [rng.choice([-1.5, -0.25, 0.0, 1 / 256, rng.gauss(0, 1)]) for _ in range(6)], rng.choice(["a", None])) for i in range(130)]
    rows += [(1, [0.5] * 6, "hot")] * 200
    got = vector_codes.compress(table(spark, rows).repartition(5), parts=3, entries=7)
    want, digest = by_hand(rows, 3, 7, 2)
    found = got.collect()
    per = {}
    for _, _, error, label in want:
        per[label] = per.get(label, 0) + error
    assert sorted((r.vec_id, r.code, r.error, r.label or "", r.label_error) for r in found) == sorted(
        (i, code, error, label or "", per[label]) for i, code, error, label in want
    )
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_ties_go_to_the_first_entry_and_unused_entries_stay(spark):
    rows = [(1, [1.0, 1.0], None), (2, [1.0, 1.0], None), (3, [-1.0, 3.0], None)]
    got = vector_codes.compress(table(spark, rows), parts=1, entries=3).orderBy("vec_id").collect()
    assert [r.code for r in got] == ["00", "00", "02"] and [r.error for r in got] == [0, 0, 0]


def test_rows_without_a_usable_vector_go(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [1.0, nan], "a"), (3, [inf, 1.0], "a"), (4, [None, 1.0], "a"), (5, [1.0, 2.0], "a")]
    rows += [(None, [3.0, 4.0], "a"), (6, [1.0], "a"), (7, [], None)]
    got = {r.vec_id: r for r in vector_codes.compress(table(spark, rows), parts=2, entries=4).collect()}
    assert set(got) == {5, None, 6, 7}
    assert (got[5].code, got[5].error, got[5].label_error) == ("0000", 0, 0)
    assert got[None].code == "0101" and got[6].code is None and got[7].error is None
    none = vector_codes.compress(table(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_what_has_no_exact_answer_is_an_error(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 5, "a")]), parts=2)
    with pytest.raises(OverflowError):
        vector_codes.compress(table(spark, [(1, [1e30, 0.0], "a")]), parts=1)

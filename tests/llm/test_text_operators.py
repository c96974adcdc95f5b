"""Small fixtures for the training-text operators: nulls, empties, ties, repeats, clashing columns, brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cashtide.llm import (
    bpe,
    chat,
    components,
    decontaminate,
    exact_dedup,
    language,
    license_scan,
    parity_join,
    quality,
    query_quality,
    sharding,
    url_filter,
)
from cashtide.llm.url_filter import Rule

DOCS = "doc_id long, text string, lang string, n_tokens string, keep_id string, score string"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near town".split()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def hostile(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "a" * 3000)]
    return docs_of(spark, [*texts, (7, long_text), (8, long_text + " end"), (None, "lost id"), (9, "é日本 <|endoftext|> 👍x")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_is_the_library(spark, hostile, none):
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.decode(bpe.encode(hostile, vocabulary), vocabulary).collect()
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == (row.text or "")
    codec = bpe.Codec(vocabulary)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aethio n'\n1é👍<|>") for _ in range(rng.randrange(80)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text
    found = bpe.digests(hostile, vocabulary).where("doc_id = 1").first()
    assert (found.n_tokens, found.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(none, vocabulary).count() == 0


def test_exact_dedup(hostile, none):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.classes(hostile, capacity=2).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1, empty].keep_id == 2 and rows[1, empty].group_size == 2 and not rows[1, empty].kept
    assert rows[5, hashlib.sha256(b"one two").hexdigest()].group_size == 3
    kept = exact_dedup.survivors(hostile)
    assert kept.columns == hostile.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.survivors(none).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(500)])
    index = exact_dedup.build_index(docs, capacity=16)
    assert index.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 16
    assert index.count() == 500


def test_the_owner_of_a_bucket_decides_its_chains(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "key_of", lambda text: F.xxhash64(F.length(text) % 40))  # chains of several texts
    texts = [(i, f"text {i % 90} " + "x" * (i % 70)) for i in range(900)]
    texts += [(1000 + i, "often") for i in range(200)] + [(None, "lost id"), (None, "lost id"), (3000, None), (3001, "")]
    docs = docs_of(spark, texts).repartition(3)
    newest, size = {}, {}
    for i, text in texts:
        newest[text or ""] = max(newest.get(text or "", -1), -1 if i is None else i)
        size[text or ""] = size.get(text or "", 0) + 1
    rows = docs.select(exact_dedup.key_of(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("row"))
    found, slots, depth = exact_dedup.entries(rows, capacity=4)
    owned = found.withColumn("owner", F.spark_partition_id()).collect()
    assert {r.text: -1 if r.row is None else r.row for r in owned} == newest and len(owned) == len(newest)
    assert {r.text: r.n_rows for r in owned} == size
    named = {r.slot: r for r in slots.collect()}
    assert all(named[(r.key % 2**64) >> (64 - depth)].bucket == r.bucket for r in owned)
    assert len({r.bucket for r in owned}) > 4 and max(r.n_hashes for r in named.values()) <= 4
    assert len({(r.bucket, r.owner) for r in owned}) == len({r.bucket for r in owned})
    classes = exact_dedup.classes(docs, capacity=4).collect()
    assert len(classes) == len(texts) and max(r.chain for r in classes) > 0
    wanted = {hashlib.sha256(t.encode()).hexdigest(): (None if i < 0 else i, size[t]) for t, i in newest.items()}
    assert all((r.keep_id, r.group_size) == wanted[r.text_sha256] for r in classes)
    # A directory that knows no hash loses no row.
    assert exact_dedup.addressed(rows, slots.limit(0), depth).count() == len(texts)


def test_parity_join_against_brute_force(spark, hostile, none):
    rng = random.Random(7)
    texts = []
    for i in range(160):
        words = list(BASE) * rng.choice([1, 3, 9])
        words = [f"{w}{j // len(BASE)}g{i % 8}" for j, w in enumerate(words)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    for k, percent in ((3, 90), (5, 80)):
        sets = {i: parity_join.shingle_set(parity_join.WORDS.split(t.encode()), k) for i, t in texts}
        least = {i: i for i in sets}
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low, high = sorted((least[i], least[j]))
                    least = {n: low if c == high else c for n, c in least.items()}
        rows = parity_join.near_classes(docs_of(spark, texts), k, percent).collect()
        assert {r.doc_id: r.component_id for r in rows} == least
        assert all(r.n_shingles == len(sets[r.doc_id]) for r in rows)
    odd = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_classes(hostile, 3, 90).collect()}
    assert odd[1] == (0, 1) and odd[3] == (0, 3) and odd[5] == (1, 4) and odd[8][1] == 7 and odd[None][1] is None
    assert parity_join.near_classes(none).count() == 0
    assert parity_join.one_of_each(docs_of(spark, texts)).columns == hostile.columns


def test_parity_keys_join_alike_sets_and_few_others():
    rng = np.random.default_rng(2)
    for size in (1, 3, 8, 20, 60, 110, 150, 200):
        sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(1500)]
        held = np.concatenate([np.unique(parity_join.bucket_keys(s, 80)) for s in sets])
        assert np.unique(held, return_counts=True)[1].max() <= 15  # of sets that share nothing, 1 %
        for s in sets[:150]:
            cut = parity_join.differing(size, size, 80) // 2
            new = np.unique(np.r_[s[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)])
            assert len(np.intersect1d(parity_join.bucket_keys(s, 80), parity_join.bucket_keys(new, 80)))


def test_parity_join_deals_a_hot_bucket_out(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "TILE_ROWS", 20)
    monkeypatch.setattr(parity_join, "TILE", 7)
    rng = random.Random(9)
    rows = [(1, i, 100, 0 if i < 90 else i) for i in range(150)] + [(2, i, 100, i % 2) for i in range(4)] + [(3, i, 9, 7) for i in range(50)]
    dealt = parity_join.tiled(spark.createDataFrame(rows, "key long, node long, n int, component long"), 80).collect()
    tiles, met = {}, set()
    for r in dealt:
        tiles.setdefault((r.key, r.left, r.right), {}).setdefault(r.tile, []).append((r.node, r.component))
    for (key, left, right), of_tile in tiles.items():
        assert key != 3 and all(len(t) <= 45 for t in of_tile.values())
        pairs = [(key, *sorted((x[0], y[0]))) for x in of_tile.get(left, []) for y in of_tile.get(right, []) if x[1] != y[1]]
        met |= set(pairs)
    wanted = {(k, *sorted((a, b))) for k, a, _, c in rows for m, b, _, d in rows if k == m and c != d}
    assert met == wanted and len(tiles) > 15
    # Two groups of near copies that share their blocks with each other's neighbours.
    texts = []
    for i in range(140):
        words = [f"{w}{j}" for j in range(5) for w in BASE]
        for _ in range(rng.randrange(3, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    sets = {i: parity_join.shingle_set(parity_join.WORDS.split(t.encode()), 3) for i, t in texts}
    least = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = {n: low if c == high else c for n, c in least.items()}
    found = {r.doc_id: r.component_id for r in parity_join.near_classes(docs_of(spark, texts), 3, 80).collect()}
    assert found == least and len(set(least.values())) > 2


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(0, 200)], rng.integers(0, 2**63, 40, dtype=np.uint64)])
        apart = np.bitwise_count(parity_join.sketch(a, 9) ^ parity_join.sketch(b, 9)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 91), (99, 99), (None, 3)], "a long, b long")
    rows = {r.node: r.component for r in components.components(edges).collect()}
    assert rows == {**{i: 0 for i in range(41)}, 90: 90, 91: 90, 99: 99}


def test_decontamination(spark, hostile, none):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(5000))
    texts = [(20, f"{filler} {item.upper()} {filler}"), (21, filler), (22, item.replace("mu", "nu")), (23, item[:30])]
    planted = docs_of(spark, texts).union(hostile)
    found = decontaminate.find(planted, items).collect()
    assert sorted({(r.doc_id, r.item_id) for r in found}) == [(4, 4), (5, 4), (20, 1), (22, 1)]
    assert decontaminate.find(none, items).count() == 0 and decontaminate.find(planted, items.limit(0)).count() == 0
    cleaned = decontaminate.clean(planted, items)
    assert cleaned.columns == planted.columns
    assert {21, 23, 1, 2, 7, 9} <= {r.doc_id for r in cleaned.collect()} and cleaned.where("doc_id = 20").count() == 0


def test_license_scan(spark, hostile, none):
    text = "Intro.\nReleased under the MIT License. Apache License, version 2\nunder the mit license"
    notice = license_scan.NOTICES[0][1]
    rows = {r.doc_id: r for r in license_scan.scan(docs_of(spark, [(1, text), (2, notice), (3, None), (4, "")])).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (3, 2, 10, "apache-2,mit")
    assert (rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "mit", 1.0)
    assert rows[3].n_words == 0 and rows[4].labels == "" and rows[4].score == 0.0
    assert license_scan.scan(hostile).count() == hostile.count() and license_scan.scan(none).count() == 0


def test_sharding_laws(spark, hostile, none):
    rng = random.Random(5)
    docs = docs_of(spark, [(i, "same text" if i % 3 == 0 else "w" * rng.randrange(1, 400)) for i in range(3000)])
    rows = sharding.assign(docs).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.03 * sizes.mean()
    assert (rows.groupby("shard").slot.apply(sorted).apply(lambda s: s == list(range(len(s))))).all()
    odd = sharding.assign(hostile).toPandas()
    assert len(odd) == hostile.count() and odd["size"].min() == 1
    assert sharding.assign(none).count() == 0


def test_shards_of_repeated_rows_are_of_equal_size(spark, tmp_path):
    """A third of the bytes is one row, repeated; another group is one text under many ids."""
    rng = random.Random(6)
    rows = [(7, "the same row " * 8)] * 3000 + [(100 + i, "one text") for i in range(4000)] + [(i, "w" * rng.randrange(1, 300)) for i in range(3000)]
    docs = docs_of(spark, rows).repartition(5)
    placed = sharding.assign(docs).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and len(placed) == 10_000 and sizes.max() - sizes.min() < 0.03 * sizes.mean()
    assert (placed.groupby("shard").slot.apply(sorted).apply(lambda s: s == list(range(len(s))))).all()
    assert placed[placed.doc_id == 7].shard.nunique() >= 3
    # Nobody knows rows that are alike apart, but every row is there once and the sizes are the law's.
    sharding.write(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard", "slot"]) and back.drop("shard", "slot").exceptAll(docs).count() == 0
    assert back.count() == 10_000 == back.select("shard", "slot").distinct().count()


def test_sharding_against_a_plain_count(spark):
    """The boundaries hold the bytes that sorting all rows by the key would give, within the tolerance."""
    rng = random.Random(8)
    docs = docs_of(spark, [(i, "x" * rng.randrange(0, 900)) for i in range(2000)])
    rows = sharding.keyed(docs)
    found = sharding.find_boundaries(rows, 5)
    ordered = sorted((r.major, r.minor, r.tie, r["size"]) for r in rows.collect())
    fair = sum(r[3] for r in ordered) / 5
    for i, b in enumerate(found, 1):
        below = sum(size for *key, size in ordered if tuple(key) < (b.major, b.minor, b.tie))
        assert below == b.below and abs(below - i * fair) <= max(sharding.TOLERANCE * fair, 901)


def test_chat_round_trip(spark):
    hard = "<|im_end|>\n<\\|im_sep|> \\ <|im_start|>x<"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 1, None, None), (2, 0, "tool", ""), (None, 0, "user", "a")]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(turns)
    read = done.select("conv_id", "valid", "first_bad_turn", chat.read_turns(done["formatted"]).alias("t"), chat.read_loss(done["segments"]).alias("l"))
    rows = {r.conv_id: r for r in read.collect()}
    assert [tuple(t) for t in rows[1].t] == [("user", hard), ("assistant", hard)] and rows[1].l == hard and rows[1].valid
    assert [tuple(t) for t in rows[2].t] == [("tool", ""), ("", "")] and rows[2].first_bad_turn == 0 and rows[2].l == ""
    assert not rows[None].valid
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_url_filter(spark):
    page = '<html><link href="{0}" rel="canonical"></html>'
    pages = [
        (1, "http://Shop.COM/de/x", page.format("https://other.net/x")), (2, "https://other.net/x#top", ""),
        (3, "http://a.org/1", page.format("//other.net/x")), (4, None, None), (5, "no scheme", ""),
        (6, "http://free.net/?utm_source=q", '<meta http-equiv="refresh" content="0; url=/x">'), (7, "https://www.shop.com/de", ""),
        (8, "http://shop.com/de/", ""), (8, "http://shop.com/de/", ""), (9, "http://b.net?x", None),
    ]
    rules = [Rule("allow", "org/"), Rule("block", "com/de/")]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    found = {r.page_id: r for r in rows.collect()}
    assert rows.count() == len(pages)
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("shop.com", "/de/x", "com/de/", "block")
    assert found[2].verdict == "allow" and found[3].rule == "org/"  # an allowed alias comes before a blocked one
    assert (found[4].host, found[4].path, found[5].host, found[9].path) == ("", "", "", "")
    assert found[7].rule is None and found[7].verdict == "block"  # redirects to the blocked /de/


def test_url_filter_judges_names_that_no_page_has(spark):
    link = '<link rel="canonical" href="{0}">'
    pages = [
        (1, "http://a.net/1", link.format("http://gone.com/de/x")), (2, "http://b.net/2", link.format("http://gone.com/de/x")),
        (3, "http://c.net/3", '<meta http-equiv="refresh" content="0; url=http://gone.com/de/y?ref=q">'),
        (4, "http://d.net/4", link.format("http://gone.com/de/z")), (5, "http://e.net/5", link.format("http://free.org/5")),
        (6, "http://f.net/6", ""), (7, "http://g.net/7", link.format("http://h.net/7")), (8, "http://i.net/8", ""),
    ]
    moved = [("http://d.net/4", "http://free.org/4"), ("http://f.net/6", "http://gone.com/de/6"), ("http://gone.com/de/8", "http://i.net/8")]
    rules = [Rule("allow", "org/"), Rule("block", "com/de/")]
    rows = url_filter.judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"), rules, spark.createDataFrame(moved, "source string, target string")
    )
    found = {r.page_id: (r.rule, r.verdict) for r in rows.collect()}
    assert {i for i, v in found.items() if v == (None, "block")} == {1, 2, 3, 6, 8}
    assert {i for i, v in found.items() if v == (None, "allow")} == {4, 5, 7}


def test_language(spark, hostile, none):
    rng = random.Random(2)
    words = {"en": "the and thing house water".split(), "de": "der und straße haus über".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tried = docs_of(spark, [(1, "the house and the water"), (2, "über der straße und haus"), (3, None), (4, "123 !?")])
    found = {r.doc_id: r for r in language.identify(tried, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and found[3].score == 0.0
    assert language.accepted(hostile, model).columns == hostile.columns
    assert language.identify(none, language.fit(none)).count() == 0


def test_language_sample_is_bounded_for_any_ids(spark):
    ids = [None] * 3000 + [7] * 3000
    texts = [f"text {i}" for i in range(5000)] + ["one and the same"] * 1000
    rows = list(zip(ids, texts, ["en", "de"] * 3000, strict=True))
    chosen = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 400).collect()
    assert 300 < len(chosen) < 500 and len(set(chosen)) == len(chosen)
    assert {r.doc_id for r in chosen} == {None, 7} and {r.lang for r in chosen} == {"en", "de"}


def test_quality_learns_and_takes_any_text(spark, hostile, none):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(BASE, k=60)) if i % 2 else "".join(rng.choices("#$%*&! ", k=300)) for i in range(200)]
    docs = docs_of(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    rows = quality.rate(docs, net).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rows) >= 190
    assert all(0 <= r.score <= 1 for r in quality.rate(hostile, net).collect())
    assert quality.rate(none, quality.fit(none, labels)).count() == 0


def test_quality_learns_from_long_texts_and_repeated_ids(spark):
    """All labelled texts are long and tell by what stands in one part of them; an id with a third of the rows is one."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(BASE, k=5000)) + ("#$%*&!" * 900 if i % 2 == 0 else "") for i in range(120)]
    assert min(map(len, texts)) > quality.STEP * quality.SAMPLE_CHUNKS
    docs = docs_of(spark, [*enumerate(texts), *[(1, "least of the repeated")] * 60])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1)] * 60, "doc_id long, quality int")
    rows = quality.rate(docs, quality.fit(docs, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rows) >= 0.9 * len(rows)


def test_chunks_of_long_texts_cover_the_whole():
    text = b"".join(i.to_bytes(4, "big") for i in range(50_000))
    some = quality.some_chunks(text, 10)
    places = np.array([int.from_bytes(row[:4].tobytes(), "big") * 4 for row in some])
    assert places[0] < 20_000 and places[-1] > 175_000 and (np.diff(places) > 0).all() and np.diff(places).max() < 41_000
    assert quality.some_chunks(b"", 10).shape == (1, quality.CHUNK)
    assert (quality.some_chunks(text[:5000], 10) == quality.chunks(text[:5000])).all()


def test_quality_of_held_out_documents(spark):
    """Accuracy on the table's own labels that the fit has not seen."""
    sf_dir = "/root/testdata/sf0.01"
    scored = query_quality.op10_quality(spark, sf_dir).where("held_out")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("quality IS NOT NULL").collect()
    right = sum(r.predicted == r.quality for r in rows)
    most = max(sum(r.quality == k for r in rows) for k in (0, 1))
    assert len(rows) > 100 and right > most and right >= 0.9 * len(rows)


def test_quality_slopes():
    net = quality.Network.random(np.random.default_rng(0))
    for part in net.parts:
        part *= 0.2
    cut, labels = [quality.chunks(b"some text here " * 90), quality.chunks(b"!!")], np.array([1, 0], np.float32)

    def loss():
        out = [quality.score(net, t) for t in (b"some text here " * 90, b"!!")]
        return -(np.log(out[0]) + np.log(1 - out[1])) / 2

    slope = quality.gradient(net, cut, labels)[1]
    i = np.unravel_index(np.abs(slope).argmax(), slope.shape)
    before = loss()
    net.filters[i] -= 1e-2 * np.sign(slope[i])
    assert loss() < before


def test_words_are_split_as_hashed():
    words = parity_join.WORDS
    text = "A b\tB  a\né x".encode()
    hashes = words.hashes(text)
    assert words.split(text) == re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4

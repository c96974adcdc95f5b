"""The corpus pipeline on a small corpus with hostile rows: every stage against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cashtide.llm import exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, digest string"
WORDS = {
    "en": "the of and that with which from have this they were would there their about other".split(),
    "de": "der und die das nicht mit sich auch auf eine wird sind noch einer haben nach".split(),
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = lambda lang, n: " ".join(f"{w}{rng.choice(['', 'a', 'er', 'ing'])}" for w in rng.choices(WORDS[lang], k=n))
    rows = [(i, prose("en" if i % 2 else "de", rng.randrange(40, 90)), "en" if i % 2 else "de") for i in range(160)]
    texts = {i: t for i, t, _ in rows}
    rows += [(200 + i, texts[i], "en") for i in range(0, 12, 3)]  # exact copies
    rows += [(300 + i, texts[i] + " tail", "de") for i in range(20, 30, 2)]  # near copies
    rows += [(400, texts[40] + " " + prose("en", 30), "en")]  # shares much, but not enough
    item = prose("en", 25)
    rows += [(500, prose("en", 30) + " " + item + " " + prose("en", 30), "en"), (501, item, "en")]
    rows += [(600, None, None), (601, "", "en"), (602, "  \n", "de"), (603, "12 34 ...", None), (None, prose("de", 50), "de")]
    rows += [(604, prose("de", 20_000), "de"), (605, texts[50], "de"), (605, texts[50], "de")]
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in rows], DOCS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_every_stage_against_plain_python(spark, corpus):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test-pipeline")
        kept[name] = before, docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(f.split()[0] for f in DOCS.split(", "))

    before, after = kept["language ID"]
    clean = {r.doc_id for r in before if (r.doc_id or 0) < 600 and r.text and r.text.strip()}
    assert clean <= {r.doc_id for r in after}
    assert not {r.doc_id for r in after} & {600, 601, 602, 603}

    before, after = kept["exact dedup"]
    newest = {}
    for r in before:
        newest[r.text or ""] = max(newest.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in after) == sorted(newest.items())

    before, after = kept["n-gram Jaccard join"]
    sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    expected = {i for i in sets if root(i) == i}
    assert {r.doc_id for r in after} - {None} == expected and len(expected) < len(sets)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = kept["benchmark decontamination"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if item in (r.text or "")} == {500, 501}

    before, after = kept["BPE encoding and decoding"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, after))


def test_an_empty_corpus_gives_nothing(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_dedup_comes_through_the_index(spark, corpus, monkeypatch):
    dealt, directory = [], exact_dedup.directory

    def small(hashes, capacity):
        slots, depth = directory(hashes, 4)
        dealt.append(slots.count())
        return slots, depth

    monkeypatch.setattr(exact_dedup, "directory", small)
    monkeypatch.setattr(exact_dedup, "key_of", lambda text: F.xxhash64(F.length(text) % 50))  # texts that share a hash
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    stage = corpus_pipeline.drop_equal_texts(spark, docs, corpus[0])
    kept = stage.collect()
    assert len(dealt) == 1 and dealt[0] > 4
    newest = {}
    for r in docs.collect():
        newest[r.text or ""] = max(newest.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept) == sorted(newest.items())
    plan = stage._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [bucket" in plan

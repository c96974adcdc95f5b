"""Ranked lexical search: an inverted index in shards of documents, Block-Max MaxScore in each, heaps merged.

The index is built in one pass over the texts, after one that counts documents and terms: a task cuts its
documents into shards of bounded size and stores a row per shard and term. Nothing is shuffled. A search takes the
items in blocks of bounded size; of the index it moves the lists of the block's terms only, dealt out by shard,
and every shard returns a heap of ``k`` documents for each item. Heaps are merged by Spark, partly before they are
moved.

Scores are integers: a document's is the sum over the item's terms, repeats included, of ``weight * impact`` with
``weight = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
``impact = 1000000000 tf div (1000 tf + 8 (25 + 75 n N div L))``, where N documents hold a term, L is the number of all
their terms, n that of one document and df the documents that hold the term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.llm.maxscore import PostingList, best
from cashtide.llm.postings import INDEX_TYPES, ShardBuilder, index_rows
from cashtide.llm.tables import written
from cashtide.session import scratch_dir

#: What makes a shard full: characters of its texts, documents.
SHARD_CHARS, SHARD_DOCS = 16 << 20, 1 << 15

#: Characters of the terms of items that are searched for together.
BLOCK_CHARS = 1 << 20

K = 10

# A term in Java's and in Python's words: runs of letters, digits and everything beyond ASCII.
TERM_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"

INDEX = "shard long, term string, df long, top long, last array<long>, peak array<long>, sizes array<long>, data binary"
HEAPS = "query string, doc_id long, score long"


@dataclass(frozen=True)
class Index:
    """Stored lists, and the N and L of their documents."""

    lists: DataFrame
    documents: int
    terms: int


def n_terms(text: Column) -> Column:
    """How many terms a text has; 0 for NULL. Each run of other characters around a term goes with it."""
    marks = F.regexp_replace(text, f"[^{TERM_CHARS}]*+[{TERM_CHARS}]++[^{TERM_CHARS}]*+", "x")
    return F.when(text.rlike(f"[{TERM_CHARS}]"), F.length(marks)).otherwise(0).cast("long")


def lower_terms(text: Column) -> Column:
    """The terms of a text in order, A-Z lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"[{TERM_CHARS}]+"), F.lit(0))


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_chars: int = SHARD_CHARS, shard_docs: int = SHARD_DOCS) -> Index:
    """The index of all documents. Rows count each for itself, also repeated ones; NULL and texts without a term are
    in no list and no count. An empty table has an empty index."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    counted = rows.select(n_terms(F.col("text")).alias("n")).agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    documents, terms = counted.n, counted.l or 0

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, builder = TaskContext.get().partitionId() << 20, ShardBuilder()
        for batch in batches:
            for doc_id, body in zip(batch.column("key").to_pylist(), batch.column("text")):
                builder.add(doc_id, body.as_py())
                if builder.chars >= shard_chars or len(builder.ids) >= shard_docs:
                    if builder.ids:
                        yield from index_rows(shard, builder, documents, terms)
                    shard, builder = shard + 1, ShardBuilder()
        if builder.ids:
            yield from index_rows(shard, builder, documents, terms)

    return Index(written(rows.mapInArrow(shards, INDEX), "search-index"), documents, terms)


def weighted_queries(index: Index, texts: DataFrame) -> DataFrame:
    """(query, terms) of distinct item texts: ``terms`` has (term, weight), the weight times the repeats in the item."""
    counted = written(
        texts.select("query", F.explode(lower_terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")),
        "query-terms",
    )
    df = (
        index.lists.where(F.col("term").isNotNull())
        .select("term", "df")
        .join(counted.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return (
        counted.join(df, "term")
        .groupBy("query")
        .agg(F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight"))).alias("terms"))
    )


def _blocks(queries: DataFrame, limit: int) -> Iterator[list[tuple[str, list[tuple[str, int]]]]]:
    """Queries in blocks of ``limit`` characters of terms or a little more, one block at a time on the driver."""
    block, chars = [], 0
    for row in queries.toLocalIterator():
        terms = [(x.term, x.weight) for x in row.terms]
        block.append((row.query, terms))
        chars += sum(len(t) for t, _ in terms)
        if chars >= limit:
            yield block
            block, chars = [], 0
    if block:
        yield block


def shard_heaps(lists: DataFrame, block: list[tuple[str, list[tuple[str, int]]]], k: int) -> DataFrame:
    """The ``k`` best documents of every shard for every query of the block."""

    def search(group: pa.Table) -> pa.Table:
        ids, norms, held = _opened(group)
        out: list[list] = [[], [], []]
        for query, terms in block:
            docs, scores = best([(held[t], w) for t, w in terms if t in held], len(ids), k)
            out[0] += [query] * len(docs)
            out[1] += [ids[d] for d in docs]
            out[2] += scores.tolist()
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["query", "doc_id", "score"])

    words = sorted({t for _, terms in block for t, _ in terms})
    # As large as the block, which is bounded.
    wanted = F.broadcast(lists.sparkSession.createDataFrame([(w,) for w in words], "term string"))
    needed = lists.join(wanted, "term", "left_semi").select(*INDEX_TYPES.names)
    about = lists.where(F.col("term").isNull()).select(*INDEX_TYPES.names)
    # Lists are small for the work they make, so their number of tasks must not follow their bytes.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return needed.unionByName(about).repartition(tasks, "shard").groupBy("shard").applyInArrow(search, HEAPS)


def _opened(group: pa.Table) -> tuple[list[int | None], np.ndarray, dict[str, PostingList]]:
    """(document ids, length norms, lists by term) of a shard's rows."""
    ids: list[int | None] = []
    norms = np.empty(0, np.int64)
    rows = []
    for row in (r for batch in group.to_batches() for r in zip(*(c for c in batch.columns))):
        if row[1].as_py() is None:
            ids, norms = row[4].as_py(), row[5].values.to_numpy(zero_copy_only=False)
        else:
            rows.append(row)
    held = {}
    for _, term, df, top, last, peak, sizes, data in rows:
        begins = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False))])
        numbers = [x.values.to_numpy(zero_copy_only=False) for x in (last, peak)]
        held[term.as_py()] = PostingList(df.as_py(), top.as_py(), *numbers, begins, data.as_py(), norms)
    return ids, norms, held


def search(index: Index, items: DataFrame, k: int = K, text: str = "text", key: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per item its ``k`` best documents: item_id, rank (from 1), doc_id, score.

    Documents of equal score are ranked by doc_id, a missing one last. Every row of ``items`` is an item, so
    repeated rows have repeated results; an item without a term, or whose terms no document holds, has none.
    Equal texts are searched for once. Other columns are ignored.
    """
    spark = items.sparkSession
    named = items.select(F.col(key).alias("item_id"), F.col(text).alias("text"), F.sha2(text, 256).alias("query"))
    texts = named.where(F.col("text").isNotNull()).select("query", "text").dropDuplicates(["query"])
    queries = written(weighted_queries(index, texts), "queries")
    path = scratch_dir(spark, "heaps")
    spark.createDataFrame([], HEAPS).write.parquet(path)
    for block in _blocks(queries, block_chars):
        shard_heaps(index.lists, block, k).write.mode("append").parquet(path)
    heaps = spark.read.schema(HEAPS).parquet(path)
    best_first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    merged = heaps.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return named.select("item_id", "query").join(merged, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

"""op11: the ten best documents of every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import search
from cashtide.llm.tables import corpus


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(corpus(spark, sf_dir, "documents"))
    return search.search(index, corpus(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {
    "op11_lexical_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
qt AS MATERIALIZED (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM i) GROUP BY q, t),
dt AS MATERIALIZED (
    SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM dt CROSS JOIN c GROUP BY t, big_n),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d CROSS JOIN c WHERE len(w) > 0),
s AS (
    SELECT q, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM dt JOIN w USING (t) JOIN m USING (r) JOIN qt USING (t) GROUP BY q, doc_id, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10"""
}

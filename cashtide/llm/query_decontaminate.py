"""op5: benchmark items that documents hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import decontaminate
from cashtide.llm.tables import corpus


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(corpus(spark, sf_dir, "documents"), corpus(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
    SELECT {key} AS id, unnest(CASE WHEN len(w) <= 5 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' ')) END) AS s
    FROM (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}) WHERE len(w) > 0"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES = {
    "op5_decontaminate": f"""
WITH i AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
     d AS (SELECT DISTINCT id, s FROM ({_SHINGLES.format(key="doc_id", table="documents")}) WHERE s IN (SELECT s FROM i)),
     n AS (SELECT id, count(*) AS n_item FROM i GROUP BY id),
     p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM p JOIN n ON n.id = item_id WHERE 10 * n_shared >= 8 * n_item"""
}

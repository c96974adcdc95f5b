"""op12: every page as a WARC record in a ZIP package, read back by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import archives
from cashtide.llm.tables import corpus


def op12_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archives.round_trip(corpus(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op12_zip_warc": op12_zip_warc}
ORACLES = {
    "op12_zip_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS s, row_number() OVER (PARTITION BY t ORDER BY page_id) AS k,
             min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM h"""
}

"""op13: codes of every embedding, from codebooks learned on all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import vector_codes
from cashtide.llm.tables import corpus


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.compress(corpus(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_KEPT = """kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept CROSS JOIN range(16) AS s(p)),
book0 AS MATERIALIZED (
    SELECT p, e, x AS c FROM parts JOIN (
        SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (r))"""
_NEAREST = """near{n} AS MATERIALIZED (
    SELECT r, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
        SELECT r, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts JOIN book{n} USING (p)) GROUP BY r, p, x)"""
_MEANS = """mean{n} AS (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
        SELECT p, e, i, (total - (total % n + n) % n) // n AS m FROM (
            SELECT p, e, i, sum(x[i])::BIGINT AS total, count(*) AS n
            FROM near{b} CROSS JOIN range(1, 1 + (SELECT max(len(x)) FROM parts)) AS s(i) GROUP BY p, e, i))
    GROUP BY p, e),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{b} AS b LEFT JOIN mean{n} AS m USING (p, e))"""

QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {
    "op13_vector_codes": f"""
WITH {_KEPT}, {_NEAREST.format(n=0)}, {_MEANS.format(n=1, b=0)}, {_NEAREST.format(n=1)}, {_MEANS.format(n=2, b=1)}, {_NEAREST.format(n=2)},
codes AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r),
named AS (SELECT vec_id, label, code, error FROM codes JOIN kept USING (r)),
per AS (SELECT label, sum(error)::BIGINT AS label_error FROM named GROUP BY label),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM named JOIN per ON named.label IS NOT DISTINCT FROM per.label CROSS JOIN sha"""
}

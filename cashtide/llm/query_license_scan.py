"""op7: license phrases and notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import license_scan
from cashtide.llm.tables import corpus


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(corpus(spark, sf_dir, "documents"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NOTICES = ", ".join(f"('{label}', {_list(sorted(set(text.split())))})" for label, text in license_scan.NOTICES)
_PHRASES = ", ".join(f"('{label}', {_list(phrase.split())})" for phrase, label in license_scan.PHRASES.items())

QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {
    "op7_license_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, {_WORDS.format("t")} AS w FROM d),
notices(label, n) AS (VALUES {_NOTICES}),
phrases(label, p) AS (VALUES {_PHRASES}),
base AS (
    SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS pos
    FROM w CROSS JOIN phrases),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
lines AS (SELECT r, list_distinct({_WORDS.format("line")}) AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
hits AS (
    SELECT r, label, len(list_intersect(w, n)) / len(n) AS c FROM lines CROSS JOIN notices
    WHERE 10 * len(list_intersect(w, n)) >= 8 * len(n)),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM base) GROUP BY r),
best AS (SELECT r, max(c) AS c FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""
}

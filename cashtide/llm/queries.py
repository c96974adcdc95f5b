"""The thin queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cashtide.llm import (
    query_archives,
    query_bpe,
    query_chat,
    query_decontaminate,
    query_exact_dedup,
    query_language,
    query_license_scan,
    query_parity_join,
    query_quality,
    query_search,
    query_sharding,
    query_url_filter,
    query_vector_codes,
)

_MODULES = (
    query_url_filter,
    query_parity_join,
    query_chat,
    query_language,
    query_decontaminate,
    query_exact_dedup,
    query_license_scan,
    query_bpe,
    query_sharding,
    query_quality,
    query_search,
    query_archives,
    query_vector_codes,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

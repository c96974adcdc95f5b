"""Operators for preparing training text: one module per operator, one query per operator.

``queries.QUERIES`` has the thin queries, ``queries.ORACLES`` the SQL of those SQL can express.
Nothing outside this folder imports it except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""

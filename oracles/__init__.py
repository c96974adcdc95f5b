"""SQL the query results are checked against."""

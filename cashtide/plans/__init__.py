"""Whole plans built from the operators: the pipeline, and the query catalog."""

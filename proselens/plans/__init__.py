"""Whole plans: the report over documents, and the example corpus of the queries."""

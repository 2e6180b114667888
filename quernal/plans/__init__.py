"""Whole plans: the search index facade and the registered queries."""

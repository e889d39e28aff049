"""Spark engine for crawled documentation: page hierarchy, text, search and incremental maintenance."""

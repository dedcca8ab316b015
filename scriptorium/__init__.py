"""Scriptorium: a Spark-first engine for catalogues of text records."""

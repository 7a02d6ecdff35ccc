"""Spark-first engine for building, splitting and auditing labelled sequence datasets."""

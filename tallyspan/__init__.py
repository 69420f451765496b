"""Keyed measures, limit records and three-valued verdicts as Spark DataFrame pipelines."""

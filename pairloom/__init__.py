"""Corpus analytics on Spark: units, similar pairs, event logs, reports and evaluation."""

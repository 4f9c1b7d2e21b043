"""Dataflow operators of ingestion, curation reads and evaluation."""

"""Loomgraph: knowledge-candidate ingestion, curation reads and evaluation on PySpark."""

__version__ = "0.1.0"

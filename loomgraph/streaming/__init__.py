"""Ingestion of streams: the batch pipeline on each micro-batch. The ledger admits by key, so a replayed batch changes nothing."""

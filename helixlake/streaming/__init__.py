"""Incremental ingest (an addition: batches of new records into a deduplicated manifest, and best-so-far state)."""

"""Relational operators over manifests, chunks, predictions and histories."""

"""Operators for training-data pipelines: documents in, documents or per-document results out."""

"""Operators of a training-data pipeline: documents, embeddings and conversations."""

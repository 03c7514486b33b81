"""Operators on text corpora and embeddings. Nothing outside this folder imports it."""

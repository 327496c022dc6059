"""Structured Streaming entry points built on the batch operators."""

"""Structured Streaming over ledgers that are being written."""

"""Structured Streaming over changes and revisions."""

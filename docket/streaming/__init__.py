"""Incremental loads and rolling budgets as Structured Streaming."""

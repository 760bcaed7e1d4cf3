"""Structured Streaming forms of the audit and monitoring operators."""

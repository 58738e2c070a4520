"""Stateful operators in batch and Structured Streaming form."""

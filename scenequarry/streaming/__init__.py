"""Structured Streaming over ordered frames."""

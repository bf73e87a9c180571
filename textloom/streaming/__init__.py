"""Structured Streaming: metrics that add up over batches of scored records."""

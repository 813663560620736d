"""Streaming twins of batch pipelines: the same column functions, with checkpoints for resuming."""

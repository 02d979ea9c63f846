"""Checkpointed incremental work."""

"""Structured Streaming over the review log."""

from .progress import dedupe_stream, drop_covered, progress_stream, read_upserted, run_available, sessions_with_state, upsert_batches

__all__ = ["dedupe_stream", "drop_covered", "progress_stream", "read_upserted", "run_available", "sessions_with_state", "upsert_batches"]

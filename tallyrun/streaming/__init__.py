"""The append-only log and stores that follow it, with Structured Streaming."""

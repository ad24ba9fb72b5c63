"""Streams: ordered state machines over feeds, waits, leases and incremental writes on Structured Streaming."""

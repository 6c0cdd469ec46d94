"""Structured Streaming entry points. The reference has no stream
processing of its own (its 'streaming' is progress reporting), so the only
stream here is the append-only session log."""

from martlet.streaming.session_log import start_session_log_stream  # noqa: F401

"""Structured Streaming entry points."""

from thinkframe.streaming.filter_stream import start_filter_stream, start_keep_rate_stream  # noqa: F401

"""The same jobs on Structured Streaming sources."""

from .jobs import stream_assign, stream_new_signatures, stream_signatures

__all__ = ["stream_assign", "stream_new_signatures", "stream_signatures"]

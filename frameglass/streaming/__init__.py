"""Streams of new rows."""

from .apply import score_available, transform_stream

__all__ = ["score_available", "transform_stream"]

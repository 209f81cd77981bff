"""Structured Streaming: VID assignment of an impression stream.

Assignment is stateless per row and only joins a static model table, so the
batch operator runs unchanged on a streaming DataFrame (stream-static join).
The caller names the query's checkpoint folder; a restarted query resumes from it.
"""

from reachkit.streaming.assign import assign_vids_stream

__all__ = ["assign_vids_stream"]

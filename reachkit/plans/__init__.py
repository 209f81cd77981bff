"""Plan-level building blocks (distributed prefix sums, bounded broadcast, chunked
generation) and the end-to-end flows composed from the operators."""

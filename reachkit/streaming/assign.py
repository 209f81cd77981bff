"""Start a streaming VID assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reachkit.operators.assign import assign_vids
from reachkit.sources.schema import as_list


def assign_vids_stream(stream: DataFrame, vid_table: DataFrame, checkpoint_location: str, demo_cols=None,
                       mode: str = "uid_time", sink: str = "parquet", path: str | None = None,
                       query_name: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Assign VIDs to every micro-batch of ``stream`` and append them to ``sink``
    (``parquet`` at ``path``, ``memory`` for tests, or any format name).

    ``checkpoint_location`` is a folder of this query's own in shared storage: a
    query started again with it, by any application, goes on where it stopped.
    """
    if not stream.isStreaming:
        raise ValueError("assign_vids_stream expects a streaming DataFrame")
    if not checkpoint_location:
        raise ValueError("checkpoint_location must name a folder of this query's own")
    out = assign_vids(stream, vid_table, demo_cols=as_list(demo_cols), mode=mode)
    writer = out.writeStream.outputMode("append").format(sink).option("checkpointLocation", checkpoint_location)
    if query_name is not None:
        writer = writer.queryName(query_name)
    if path is not None:
        writer = writer.option("path", path)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()

"""Structured Streaming over shard directories."""

from rostrum.streaming.categories import (
    category_counts,
    clean_by_counts,
    count_categories,
    modes_so_far,
)
from rostrum.streaming.shards import (
    await_all,
    clean_stream,
    feature_stream,
    stream_lanes,
    stream_shard_batches,
    stream_shards,
    write_stream,
)

__all__ = [
    "await_all",
    "category_counts",
    "clean_by_counts",
    "clean_stream",
    "count_categories",
    "feature_stream",
    "modes_so_far",
    "stream_lanes",
    "stream_shard_batches",
    "stream_shards",
    "write_stream",
]

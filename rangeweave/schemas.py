"""Schemas of the log tables. Unsigned 32-bit values are longs; unsigned 64-bit ones are longs whose largest value stands for "no end"."""

RECORDS = "range_id long, entry_id long, batch_offset long, absolute_offset long, key binary, value string"
ENTRIES = "topic_id long, range_id long, segment_id long, entry_id long, record_count long, payload_bytes long"
RANGES = (
    "range_id long, keyspace_start binary, keyspace_end binary, state string, split_into array<long>, "
    "merged_into long, merged_from array<long>, end_entry_id long"
)
SEGMENTS = (
    "range_id long, segment_id long, state string, start_entry_id long, end_entry_id long, "
    "sealed_at_ms long, size_bytes long, replicas array<string>"
)
TOPICS = "topic_id long, name string, state string, retention_ms long, replication_factor long, partition_strategy string"
ROLLS = "range_id long, seq long, intent string"
OFFSET_LOG = "lsn long, kind string, group_id string, range_id long, generation long, entry_id long, batch_offset long"
MEMBERS = "seq long, node_id string, state string, incarnation long"
ACKS = "range_id long, entry_id long, node_id string"
APPENDS = (
    "seq long, range_id long, producer_id string, incarnation long, sequence long, digest long, "
    "expires_at long, received_at long, verified boolean"
)
NO_END = 2**63 - 1

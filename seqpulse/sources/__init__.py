from seqpulse.sources.schema import SCHEMAS, conform, validate
from seqpulse.sources.sinks import read_feed, write_csv, write_feed, write_mart
from seqpulse.sources.snapshot import day_after, snapshot
from seqpulse.sources.tables import Tables, read_frame, read_tables

__all__ = [
    "SCHEMAS", "Tables", "conform", "day_after", "read_feed", "read_frame", "read_tables", "snapshot", "validate",
    "write_csv", "write_feed", "write_mart",
]

from bankflow.sources.events import read_events_stream
from bankflow.sources.files import read_csv, read_snapshot_day, read_snapshots
from bankflow.sources.jdbc import read_jdbc, read_jdbc_window

__all__ = [
    "read_csv", "read_events_stream", "read_jdbc", "read_jdbc_window", "read_snapshot_day",
    "read_snapshots",
]

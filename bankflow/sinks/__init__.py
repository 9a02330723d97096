from bankflow.sinks.audit import record_lineage, record_run
from bankflow.sinks.tables import export_csv, write_snapshot
from bankflow.sinks.upsert import upsert

__all__ = ["export_csv", "record_lineage", "record_run", "upsert", "write_snapshot"]

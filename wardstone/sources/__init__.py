from wardstone.sources.sinks import materialise, write_bucketed, write_csv, write_results
from wardstone.sources.tables import load_tables, read_csv, read_optional

__all__ = [
    "load_tables", "materialise", "read_csv", "read_optional", "write_bucketed", "write_csv", "write_results",
]

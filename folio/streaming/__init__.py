"""Progress counters over a stream of ingest rows."""

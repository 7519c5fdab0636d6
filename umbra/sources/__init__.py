"""Sources and sinks: raw census CSV, parquet artefacts, fixture views, completion events."""

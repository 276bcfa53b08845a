"""termlake: term search, integer-set algebra, ids, telemetry and ingestion as Spark DataFrame operations."""

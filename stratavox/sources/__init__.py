"""Sources and sinks: dense chunks in Parquet, chunked array containers, tables in CSV, and volumes over the driver's tables."""

"""Sources and sinks: raw CSV scans, archive ingest, partitioned sinks and
views of the driver's test tables in the panel data model."""

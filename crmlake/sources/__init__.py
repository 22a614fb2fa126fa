"""Sources and sinks: table contracts, scans, bindings over the test tables,
snapshot writes."""

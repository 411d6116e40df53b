"""Reading messages, tables and payloads; writing versioned tables, reports and logs."""

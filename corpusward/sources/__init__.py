"""Sources and sinks: files, findings, history."""

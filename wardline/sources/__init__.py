"""Table, CSV and model sources and sinks."""

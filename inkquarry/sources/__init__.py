"""Sources and sinks: stored tables, files, plug-in boundaries and generated data."""

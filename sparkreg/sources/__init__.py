"""Sources and sinks: test tables, CSV with charset fallback, model bundles."""

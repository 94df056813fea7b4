"""Sources and sinks: line files, aligned pairs, input tables, corpus writers."""

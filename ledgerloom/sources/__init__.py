"""Sources and sinks: log files, manifests and the log writer."""
